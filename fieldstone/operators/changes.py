"""Change sets: which staged operation wins, which updates conflict, and the resulting table.

Everything is a DataFrame transformation of immutable inputs: a conflict leaves nothing behind.
Per id a delete wins over an insert, an insert over an update, and of equal kinds the last one staged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.functions.compare import any_of

SEQ = "__seq"


class ConcurrencyError(Exception):
    """Updates whose row changed or went since it was read.  ``count`` is exact; ``failed_ids`` holds
    the first ones, at most ``most`` of them; all are in ``rows``, which can be read as long as the application runs."""

    most = 1000

    def __init__(self, rows: DataFrame, key: str):
        self.rows = rows.select(key)
        self.count = self.rows.count()
        self.failed_ids = [r[0] for r in self.rows.limit(self.most).collect()]
        super().__init__(f"{self.count} rows changed since they were read: {self.failed_ids[:10]}")


class DuplicateIdError(Exception):
    """A strict insert of an id that is already there."""


@dataclass(frozen=True)
class ChangeSet:
    """One row per id: ids to delete, rows to insert, rows to update (with ``changed``, the names of the
    changed columns, if the update is partial); None where nothing is staged."""

    deletes: DataFrame | None
    inserts: DataFrame | None
    updates: DataFrame | None

    def each(self, step: Callable[[DataFrame], DataFrame]) -> ChangeSet:
        """The change set with ``step`` done to what is there."""
        return ChangeSet(*(None if d is None else step(d) for d in (self.deletes, self.inserts, self.updates)))

    def touched(self, base: DataFrame, key: str) -> DataFrame:
        """The rows of ``base`` that it touches."""
        ids = reduce(DataFrame.union, [d.select(key) for d in (self.deletes, self.inserts, self.updates) if d is not None])
        return base.join(ids, key, "left_semi").select(*base.columns)


def last_wins(staged: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """Per id the row staged last, without the sequence number: an aggregate that combines before the
    shuffle, not a sort of each id's rows."""
    kept = [c for c in staged.columns if c != seq]
    latest = staged.groupBy(key).agg(F.max_by(F.struct(*kept), F.col(seq)).alias("__row"))
    return latest.select(*[F.col("__row").getField(c).alias(c) for c in kept])


def resolve(deletes: DataFrame | None, inserts: DataFrame | None, updates: DataFrame | None, key: str, seq: str = SEQ) -> ChangeSet:
    """Applies the precedence.  ``deletes`` has the column ``key``; the others have ``seq`` too."""

    def without(rows: DataFrame, *stronger: DataFrame | None) -> DataFrame:
        for s in stronger:
            rows = rows if s is None else rows.join(s.select(key), key, "left_anti")
        return rows

    gone = None if deletes is None else deletes.select(key).distinct()
    added = None if inserts is None else without(last_wins(inserts, key, seq), gone)
    changed = None if updates is None else without(last_wins(updates, key, seq), gone, added)
    return ChangeSet(gone, added, changed)


def conflicts(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The updates that no row of ``base`` has the id and version of."""
    now = base.select(F.col(key).alias("__id"), F.col(version).alias("__version"))
    return updates.join(now, (updates[key] == now["__id"]) & (updates[version] == now["__version"]), "left_anti")


def _updated(base: DataFrame, updates: DataFrame, key: str, version: str | None) -> DataFrame:
    """``base`` with the updates of its rows; the version goes up by one."""
    partial = "changed" in updates.columns
    fields = [c for c in updates.columns if c not in (key, "changed")]
    new = updates.select(F.col(key).alias("__id"), F.struct(*fields).alias("__new"), *([F.col("changed").alias("__changed")] if partial else []))
    joined = base.join(new, base[key] == new["__id"], "left")
    hit = F.col("__id").isNotNull()

    def value(c: str) -> Column:
        if c == key or c not in fields:
            return F.col(c)
        if c == version:
            return F.when(hit, F.col("__new").getField(c) + 1).otherwise(F.col(c)).cast(base.schema[c].dataType)
        take = hit & F.array_contains("__changed", c) if partial else hit
        return F.when(take, F.col("__new").getField(c)).otherwise(F.col(c))

    return joined.select(*[value(c).alias(c) for c in base.columns])


def apply(base: DataFrame, changes: ChangeSet, key: str, version: str | None = None, strict_insert: bool = False) -> DataFrame:
    """The table after the change set.  With a version column the updates must have been checked with
    ``conflicts``; without one an update of an unknown id inserts its row."""
    deletes, inserts, updates = changes.deletes, changes.inserts, changes.updates
    if strict_insert and inserts is not None:
        twice = inserts.join(base.select(key), key, "left_semi")
        if not twice.isEmpty():
            raise DuplicateIdError(f"ids are already there: {[r[0] for r in twice.select(key).limit(10).collect()]}")
    out = base
    replaced = [d.select(key) for d in (deletes, inserts) if d is not None]
    if replaced:
        out = out.join(reduce(DataFrame.union, replaced), key, "left_anti").select(*base.columns)
    if updates is not None:
        out = _updated(out, updates, key, version)
    if inserts is not None:
        out = out.unionByName(inserts.select(*base.columns))
    if updates is not None and version is None:
        new = updates.join(base.select(key), key, "left_anti")
        out = out.unionByName(new.select(*base.columns))
    return out


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): combinations that more than one row has; combinations with a null don't count."""
    full = ~any_of([F.col(k).isNull() for k in keys])
    return rows.filter(full).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
