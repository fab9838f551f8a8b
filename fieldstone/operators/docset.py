"""Read-only sets of documents: queries, point loads, includes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.plans.filters import FilterCache, stored_names
from fieldstone.plans.model import Model, find_field

Condition = dict | Column | Callable[[DataFrame], Column] | None


class DocSet:
    """A collection as a DataFrame with its model."""

    def __init__(self, rows: DataFrame, model: Model, cache: FilterCache | None = None):
        self.rows, self.model = rows, model
        self.cache = cache or FilterCache(model.conventions.filter_cache)

    def query(self, condition: Condition = None) -> DataFrame:
        """The rows that a filter document, a Column, or a function from the rows to a Column says."""
        if condition is None:
            return self.rows
        if isinstance(condition, dict):
            return self.rows.filter(self.cache.translate(stored_names(condition, self.model.elements), self.rows.schema, self.model.id))
        return self.rows.filter(condition if isinstance(condition, Column) else condition(self.rows))

    def matching(self, test: Callable) -> DataFrame:
        """The rows for which ``test`` holds, a function from a pandas frame of rows to booleans: for conditions that no
        Column expresses.  It sees one Arrow batch at a time; use ``query`` for what is to reach the scan."""
        return self.rows.mapInPandas(lambda batches: (b[test(b)] for b in batches), self.rows.schema)

    def load(self, id_value) -> DataFrame:
        """At most one row: the one with that id."""
        return self.rows.filter(F.col(self.model.id) == self.model.id_literal(id_value)).limit(1)

    def get(self, id_value) -> Row | None:
        """That row, or None."""
        return self.load(id_value).first()


def include(roots: DataFrame, field: str, foreign: DataFrame, foreign_id: str) -> DataFrame:
    """``roots`` with ``_included_<field>``: the array of foreign rows whose id the field holds.

    A left outer equi-join: roots without a match, and with a null reference, get an empty array.
    The engine chooses broadcast or shuffle by the true size of the foreign side.  An array of
    references matches several rows, ordered by id: each distinct set of references is resolved once, by joining its items,
    and then joined with its roots.  Both sides compute the roots, so sets are compared by their sorted items: a shuffle
    may collect an array in another order each time."""
    name = f"_included_{field}"
    row = F.struct(*[F.col(c) for c in foreign.columns])
    of = find_field(roots.schema, field)
    if of is None:
        raise ValueError(f"there is no field '{field}'")
    right = foreign.select(F.col(foreign_id).alias("__id"), row.alias("__row"))
    none = F.array().cast(T.ArrayType(right.schema["__row"].dataType))
    if not isinstance(of.dataType, T.ArrayType):
        out = roots.join(right, roots[of.name] == right["__id"], "left")
        return out.withColumn(name, F.when(F.col("__id").isNotNull(), F.array("__row")).otherwise(none)).drop("__id", "__row")
    items = F.sort_array(F.array_distinct(F.array_compact(roots[of.name])))
    wanted = roots.select(items.alias("__refs")).distinct().select("__refs", F.explode("__refs").alias("__ref"))
    got = wanted.join(right, wanted["__ref"] == right["__id"]).groupBy("__refs").agg(F.collect_list(F.struct("__id", "__row")).alias("__all"))
    out = roots.join(got, items == got["__refs"], "left")
    by_id = F.transform(F.sort_array("__all"), lambda x: x["__row"]) if _sortable(right.schema["__row"].dataType) else None
    if by_id is None:
        by_id = F.transform(F.array_sort("__all", lambda a, b: F.when(a["__id"] < b["__id"], -1).when(a["__id"] > b["__id"], 1).otherwise(0)), lambda x: x["__row"])
    return out.withColumn(name, F.coalesce(by_id, none)).drop("__refs", "__all")


def _sortable(of: T.DataType) -> bool:
    """Whether values of the type can be ordered."""
    if isinstance(of, T.StructType):
        return all(_sortable(f.dataType) for f in of.fields)
    return _sortable(of.elementType) if isinstance(of, T.ArrayType) else not isinstance(of, (T.MapType, T.VariantType))


def included_rows(roots: DataFrame, field: str, foreign: DataFrame, foreign_id: str) -> DataFrame:
    """The foreign rows that the roots refer to, each once: what an include makes loadable."""
    of = find_field(roots.schema, field)
    refs = roots.select(F.explode(of.name).alias("__ref")) if isinstance(of.dataType, T.ArrayType) else roots.select(F.col(of.name).alias("__ref"))
    return foreign.join(refs, foreign[foreign_id] == refs["__ref"], "left_semi")


def missing(wanted: DataFrame, field: str, found: DataFrame, found_id: str) -> DataFrame:
    """Rows of ``wanted`` whose reference is no id of ``found``."""
    keys = found.select(F.col(found_id).alias("__id"))
    return wanted.join(keys, wanted[field] == keys["__id"], "left_anti")


class Query:
    """A query over a set with includes; ``rows`` after one filter and then the joins."""

    def __init__(self, source: DocSet, resolve: Callable[[str], DocSet], condition: Condition = None, fields: tuple[str, ...] = (), to: tuple[str, ...] = ()):
        self.source, self.resolve, self.condition, self.fields, self.to = source, resolve, condition, fields, to

    def where(self, condition: Condition) -> Query:
        return Query(self.source, self.resolve, condition, self.fields, self.to)

    def include(self, field: str, collection: str | None = None) -> Query:
        """Also fetches what ``field`` refers to: of the collection named, or of the model's reference."""
        to = collection or self.source.model.reference(field)
        if to is None:
            raise ValueError(f"'{field}' refers to no known collection")
        return Query(self.source, self.resolve, self.condition, (*self.fields, self.source.model.element(field)), (*self.to, to))

    def roots(self) -> DataFrame:
        """The matching rows, without what they include."""
        return self.source.query(self.condition)

    def rows(self) -> DataFrame:
        out = self.roots()
        for field, to in zip(self.fields, self.to):
            foreign = self.resolve(to)
            out = include(out, field, foreign.rows, foreign.model.id)
        return out

    def included(self, field: str) -> DataFrame:
        field = self.source.model.element(field)
        foreign = self.resolve(self.to[self.fields.index(field)])
        return included_rows(self.roots(), field, foreign.rows, foreign.model.id)
