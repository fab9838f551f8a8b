"""Normal forms under which equal documents are equal values.

Null and empty collections are equal, arrays compare in order, maps without order, structs field by
field with null apart from a struct of nulls.  Variants have no normal form and are not compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(of: T.DataType) -> bool:
    """Whether values of the type are their own normal form."""
    return not isinstance(of, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def normal(value: Column, of: T.DataType) -> Column:
    """The normal form; types without one give null."""
    if isinstance(of, T.VariantType):
        return F.lit(None).cast("string")
    if isinstance(of, T.ArrayType):
        full = F.coalesce(value, F.array().cast(of))
        return full if plain(of.elementType) else F.transform(full, lambda x: normal(x, of.elementType))
    if isinstance(of, T.MapType):
        entries = F.map_entries(F.coalesce(value, F.create_map().cast(of)))
        made = F.transform(entries, lambda e: F.struct(normal(e["key"], of.keyType).alias("key"), normal(e["value"], of.valueType).alias("value")))
        return F.array_sort(made)
    if isinstance(of, T.StructType):
        fields = [normal(value.getField(f.name), f.dataType).alias(f.name) for f in of.fields if not isinstance(f.dataType, T.VariantType)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    return value


def differs(a: Column, b: Column, of: T.DataType) -> Column:
    """True or false: the two values are different documents."""
    return ~normal(a, of).eqNullSafe(normal(b, of))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions) if conditions else F.lit(False)
