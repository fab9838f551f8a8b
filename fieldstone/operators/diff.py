"""Row diffs: which tracked rows differ from their snapshot, in which columns, and the new values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.functions.compare import any_of, differs


def _paired(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    left = base.select(F.col(key).alias("__key"), F.struct(*base.columns).alias("old"))
    right = current.select(F.col(key).alias("__id"), F.struct(*current.columns).alias("new"))
    return left.join(right, left["__key"] == right["__id"])


def _flags(schema: T.StructType, columns: list[str]) -> dict[str, Column]:
    return {c: differs(F.col("old").getField(c), F.col("new").getField(c), schema[c].dataType) for c in columns}


def dirty(base: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of ``current`` that differ from the row of the same id in ``base``."""
    flags = _flags(base.schema, columns)
    return _paired(base, current, key).filter(any_of(list(flags.values()))).select("new.*")


def changed_fields(base: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, changed): the names of the changed columns, in schema order, of the rows that differ."""
    flags = _flags(base.schema, columns)
    names = F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])) if flags else F.array().cast("array<string>")
    return _paired(base, current, key).select(F.col("__key").alias(key), names.alias("changed")).filter(F.size("changed") > 0)


def changes(base: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, changed, row): the changed columns' names and the whole new row, for partial updates."""
    flags = _flags(base.schema, columns)
    names = F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])) if flags else F.array().cast("array<string>")
    out = _paired(base, current, key).select(F.col("__key").alias(key), names.alias("changed"), F.col("new").alias("row"))
    return out.filter(F.size("changed") > 0)


def change_documents(base: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, changes): a map from each changed column to its new value as JSON."""
    flags = _flags(base.schema, columns)
    entries = [F.when(f, F.struct(F.lit(c).alias("key"), F.to_json(F.struct(F.col("new").getField(c).alias(c))).alias("value"))) for c, f in flags.items()]
    made = F.map_from_entries(F.array_compact(F.array(*entries)))
    return _paired(base, current, key).select(F.col("__key").alias(key), made.alias("changes")).filter(F.size("changes") > 0)
