"""Index definitions: what they mean where there are no indexes.

A unique index is a check of the new rows before they are published; sorted keys are a layout of the
files, whose statistics let scans skip what they don't need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .changes import unique_violations


@dataclass(frozen=True)
class Index:
    """Keys of one collection; by default named after the collection, or ``<collection>_i``."""

    collection: str
    keys: tuple[str, ...]
    unique: bool = False
    name: str | None = None


class UniqueError(Exception):
    """Rows that share the keys of a unique index."""


@dataclass
class Indexes:
    """A registry: one definition per name; a different one of the same name is an error unless forced."""

    by_name: dict[str, Index] = field(default_factory=dict)

    def add(self, index: Index, force: bool = False) -> str:
        name = index.name
        if name is None:
            name, i = index.collection, 0
            while name in self.by_name and self.by_name[name] != index:
                i += 1
                name = f"{index.collection}_{i}"
        if name in self.by_name and self.by_name[name] != index and not force:
            raise ValueError(f"index '{name}' has another definition")
        self.by_name[name] = index
        return name

    def discover(self, *places: object, force: bool = False) -> list[str]:
        """Adds all definitions that modules, classes or other objects hold as attributes, by attribute name."""
        found = [v for place in places for _, v in sorted(vars(place).items()) if isinstance(v, Index)]
        return [self.add(index, force) for index in found]

    def ensure(self, rows: Callable[[str], DataFrame]) -> None:
        """Checks every unique index on the rows of its collection, as ``rows`` gives them by name; raises UniqueError that
        names all that fail."""
        failed = []
        for index in self.by_name.values():
            try:
                check_indexes(rows(index.collection), [index])
            except UniqueError as error:
                failed.append(str(error))
        if failed:
            raise UniqueError("; ".join(failed))

    def of(self, collection: str) -> list[Index]:
        return [i for i in self.by_name.values() if i.collection == collection]


def check_indexes(rows: DataFrame, indexes: Iterable[Index]) -> None:
    """Raises UniqueError for the first unique index that two rows share the keys of."""
    for index in indexes:
        if index.unique:
            twice = unique_violations(rows, list(index.keys)).limit(10).collect()
            if twice:
                raise UniqueError(f"{index.collection} {index.keys}: {[tuple(r)[:-1] for r in twice]}")


def lay_out(store, index: Index) -> int:
    """Writes a stored collection anew in ranges of the index's keys, sorted by the first."""
    return store.fold(index.collection, index.keys)
