"""Collection models: schema, id and version columns, element names, conventions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_field(schema: T.StructType, name: str) -> T.StructField | None:
    """The field of that name, or else the one that differs in case only."""
    for f in schema.fields:
        if f.name == name:
            return f
    return next((f for f in schema.fields if f.name.lower() == name.lower()), None)


def marked_or_named_id(schema: T.StructType) -> str | None:
    """The id convention: a field with metadata ``{"id": true}``, else one named id in any case."""
    marked = next((f.name for f in schema.fields if (f.metadata or {}).get("id")), None)
    if marked:
        return marked
    named = find_field(schema, "Id") or find_field(schema, "_id")
    return named.name if named else None


def prefixed_uuid(collection: str) -> Column:
    """``<Collection>/<uuid>``.  Materialise the result before using it twice."""
    return F.concat(F.lit(f"{collection}/"), F.uuid())


@dataclass(frozen=True)
class Conventions:
    """How ids are found and made, the version attribute (None: no optimistic concurrency), whether
    publishing must be atomic, how many translated filters are remembered, and the bucket of attachments."""

    find_id: Callable[[T.StructType], str | None] = marked_or_named_id
    make_id: Callable[[str], Column] = prefixed_uuid
    version_attribute: str | None = "Version"
    atomic: bool = True
    strict_insert: bool = False
    filter_cache: int = 1000
    bucket: str = "fs"


@dataclass(frozen=True)
class Model:
    """One collection.  The schema has the stored element names; ``elements`` maps other attribute names to them, which
    filters, includes and diffs then take too; ``references`` maps reference fields to the collections they point to;
    ``ignored`` columns are not tracked."""

    name: str
    schema: T.StructType
    id_column: str | None = None
    elements: dict[str, str] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    conventions: Conventions = Conventions()

    def element(self, attribute: str) -> str:
        """The stored name of an attribute."""
        return self.elements.get(attribute, attribute)

    def reference(self, attribute: str) -> str | None:
        """The collection that a field refers to, given by its attribute or its stored name."""
        stored = self.element(attribute)
        return next((to for name, to in self.references.items() if self.element(name) == stored), None)

    @property
    def id(self) -> str:
        found = self.id_column or self.conventions.find_id(self.schema)
        if not found:
            raise ValueError(f"{self.name} has no id column")
        return found

    @property
    def version(self) -> str | None:
        """The version column; None if the convention is off or no such field is there."""
        name = self.conventions.version_attribute
        at = find_field(self.schema, self.element(name)) if name else None
        return at.name if at and isinstance(at.dataType, T.IntegralType) else None

    @property
    def tracked(self) -> list[str]:
        """Columns that change tracking compares: no id, version, ignored or untyped columns."""
        skip = {self.id, self.version, *map(self.element, self.ignored)}
        return [f.name for f in self.schema.fields if f.name not in skip and not isinstance(f.dataType, T.VariantType)]

    def id_literal(self, value) -> Column:
        """An id as the id column's type; null ids are refused."""
        if value is None:
            raise ValueError(f"{self.name}: an id must not be null")
        return F.lit(value).cast(self.schema[self.id].dataType)

    def with_ids(self, rows):
        """``rows`` with ids made where they are null or empty strings."""
        at = F.col(self.id)
        if not isinstance(self.schema[self.id].dataType, T.StringType):
            return rows
        return rows.withColumn(self.id, F.when(at.isNull() | (at == ""), self.conventions.make_id(self.name)).otherwise(at))
