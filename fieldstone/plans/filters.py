"""Filter documents compiled to Columns.

``translate({"Age": {"$gte": 18}, "Tags": "new"}, schema)`` gives a predicate for ``DataFrame.filter``.

Predicates are two-valued as in the filter language, while SQL has three values: negation is therefore
never put around a nullable expression.  It is pushed down to the leaves (``negated``), whose negative
forms say what null means; these forms also reach the Parquet scan, which a ``coalesce`` around the
predicate would prevent.  A null parent on a dotted path matches nothing, whatever the operator.
"""

from __future__ import annotations

import datetime
import decimal
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import find_field


@dataclass(frozen=True)
class Regex:
    """A regular expression value with flags out of i, m, s, x."""

    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Target:
    """What an operator is applied to: a column, its type, and the path for messages."""

    column: Column
    type: T.DataType
    path: str


Operator = Callable[[Target, Any, bool], Column]
OPERATORS: dict[str, Operator] = {}
_WHOLE = {"$all", "$elemmatch", "$type"}  # applied to an array itself, not to its elements


def operator(name: str, whole: bool = False) -> Callable[[Operator], Operator]:
    """Registers a field operator.  It gets (target, value, negated) and returns a predicate that is
    never null where it decides the result, in the polarity asked for."""

    def add(f: Operator) -> Operator:
        OPERATORS[name.lower()] = f
        if whole:
            _WHOLE.add(name.lower())
        return f

    return add


def literal(value: Any, of: T.DataType) -> Column:
    """A constant of a column's type; numbers are left to the usual widening."""
    if isinstance(value, Column):
        return value
    out = F.lit(value)
    widened = isinstance(of, T.NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool)
    return out if widened or (isinstance(of, T.StringType) and isinstance(value, str)) else out.cast(of)


@operator("$eq")
def _eq(t: Target, value: Any, negated: bool) -> Column:
    if value is None:
        return t.column.isNotNull() if negated else t.column.isNull()
    v = literal(value, t.type)
    return ~t.column.eqNullSafe(v) if negated else t.column == v


@operator("$ne")
def _ne(t: Target, value: Any, negated: bool) -> Column:
    return _eq(t, value, not negated)


def _compare(name: str, test: Callable[[Column, Column], Column]) -> None:
    @operator(name)
    def compare(t: Target, value: Any, negated: bool) -> Column:
        if value is None:
            return F.lit(negated)
        c = t.column
        hit = test(c, literal(value, t.type))
        # NaN compares false here, while Spark puts it above all numbers.
        nan = isinstance(t.type, (T.DoubleType, T.FloatType)) and name in ("$gt", "$gte")
        if negated:
            return c.isNull() | F.isnan(c) | ~hit if nan else c.isNull() | ~hit
        return hit & ~F.isnan(c) if nan else hit


_compare("$gt", lambda c, v: c > v)
_compare("$gte", lambda c, v: c >= v)
_compare("$lt", lambda c, v: c < v)
_compare("$lte", lambda c, v: c <= v)


def _listed(t: Target, value: Any, op: str) -> list:
    if isinstance(value, (str, bytes, dict)) or not hasattr(value, "__iter__"):
        raise NotImplementedError(f"{op} on '{t.path}' takes a list")
    return list(value)


@operator("$in")
def _in(t: Target, value: Any, negated: bool) -> Column:
    values = _listed(t, value, "$in")
    some, null = [literal(v, t.type) for v in values if v is not None], None in values
    c = t.column
    if not some:
        return (c.isNotNull() if negated else c.isNull()) if null else F.lit(negated)
    hit = c.isin(some)
    if negated:
        return c.isNotNull() & ~hit if null else c.isNull() | ~hit
    return hit | c.isNull() if null else hit


@operator("$nin")
def _nin(t: Target, value: Any, negated: bool) -> Column:
    return _in(t, value, not negated)


@operator("$all", whole=True)
def _all(t: Target, value: Any, negated: bool) -> Column:
    values = _listed(t, value, "$all")
    if not isinstance(t.type, T.ArrayType):
        raise TypeError(f"$all needs a collection; '{t.path}' is {t.type.simpleString()}")
    if not values:
        return F.lit(not negated)
    each = [F.exists(t.column, _equal_to(literal(v, t.type.elementType))) for v in values]
    if negated:
        return t.column.isNull() | reduce(Column.__or__, [~e for e in each])
    return reduce(Column.__and__, each)


def _equal_to(v: Column) -> Callable[[Column], Column]:
    return lambda x: x.eqNullSafe(v)


@operator("$elemMatch", whole=True)
def _elem_match(t: Target, value: Any, negated: bool) -> Column:
    if not isinstance(t.type, T.ArrayType):
        raise TypeError(f"$elemMatch needs a collection; '{t.path}' is {t.type.simpleString()}")
    if not isinstance(value, dict):
        raise NotImplementedError(f"$elemMatch on '{t.path}' takes a document")
    inner = t.type.elementType
    if not isinstance(inner, T.StructType):
        raise ValueError(f"$elemMatch on '{t.path}': its elements have no fields")
    hit = F.exists(t.column, lambda e: _document(value, inner, e.getField, False, None))
    return ~F.coalesce(hit, F.lit(False)) if negated else hit


_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


@operator("$regex")
def _regex(t: Target, value: Any, negated: bool) -> Column:
    if isinstance(value, re.Pattern):
        value = Regex(value.pattern, "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if value.flags & bit))
    r = Regex(value) if isinstance(value, str) else value
    if not isinstance(r, Regex):
        raise NotImplementedError(f"$regex on '{t.path}' takes a string or a regular expression")
    if set(r.flags) - set("imsx"):
        raise NotImplementedError(f"regex flags '{r.flags}' on '{t.path}' are not supported")
    if not isinstance(t.type, T.StringType):
        raise TypeError(f"$regex needs a string; '{t.path}' is {t.type.simpleString()}")
    if r.pattern[:1] == "^" and not r.flags and len(r.pattern) > 1 and not _META.search(r.pattern[1:]):
        hit = t.column.startswith(r.pattern[1:])  # reaches the scan, which a pattern does not
    else:
        hit = t.column.rlike("".join("(?iu)" if f == "i" else f"(?{f})" for f in r.flags) + r.pattern)
    return t.column.isNull() | ~hit if negated else hit


# Type aliases, as Spark types and as the types a variant reports.
TYPE_ALIASES: dict[str, tuple[tuple[type, ...], str]] = {
    "string": ((T.StringType,), r"^STRING"),
    "int": ((T.IntegerType, T.ShortType, T.ByteType), r"^BIGINT"),
    "long": ((T.LongType,), r"^BIGINT"),
    "double": ((T.DoubleType, T.FloatType), r"^(DOUBLE|FLOAT|DECIMAL)"),
    "bool": ((T.BooleanType,), r"^BOOLEAN"),
    "date": ((T.TimestampType, T.TimestampNTZType, T.DateType), r"^(TIMESTAMP|DATE)"),
    "objectid": ((), r"^$"),
    "guid": ((), r"^UUID"),
}


@operator("$type", whole=True)
def _type(t: Target, value: Any, negated: bool) -> Column:
    names = [value] if isinstance(value, str) else _listed(t, value, "$type")
    unknown = [n for n in names if str(n).lower() not in TYPE_ALIASES]
    if unknown or not names:
        raise NotImplementedError(f"$type on '{t.path}': unknown type {unknown}")
    known = [TYPE_ALIASES[n.lower()] for n in names]
    if isinstance(t.type, T.VariantType):
        kind = F.schema_of_variant(t.column)
        hit = kind.rlike("|".join(p for _, p in known))
        return kind.isNull() | ~hit if negated else hit
    static = any(isinstance(t.type, k) for k, _ in known)
    if negated:
        return t.column.isNull() if static else F.lit(True)
    return t.column.isNotNull() if static else F.lit(False)


@operator("$exists")
def _exists(t: Target, value: Any, negated: bool) -> Column:
    raise NotImplementedError(f"$exists on '{t.path}' is not supported: every row has every field; compare with None")


def _apply(op: str, t: Target, value: Any, negated: bool) -> Column:
    f = OPERATORS.get(op.lower())
    if f is None:
        raise NotImplementedError(f"operator '{op}' on '{t.path}' is not supported")
    if isinstance(t.type, T.ArrayType) and op.lower() not in _WHOLE:
        hit = F.exists(t.column, lambda x: _apply(op, Target(x, t.type.elementType, t.path), value, False))
        return ~F.coalesce(hit, F.lit(False)) if negated else hit
    return f(t, value, negated)


def _walk(names: list[str], t: Target, then: Callable[[Target, bool], Column], negated: bool) -> Column:
    """Goes down a dotted path: any element of an array, a field of a struct, a key of a map."""
    if not names:
        return then(t, negated)
    if isinstance(t.type, T.ArrayType):
        hit = F.exists(t.column, lambda x: _walk(names, Target(x, t.type.elementType, t.path), then, False))
        return ~F.coalesce(hit, F.lit(False)) if negated else hit
    name, path = names[0], f"{t.path}.{names[0]}"
    if isinstance(t.type, T.StructType):
        found = find_field(t.type, name)
        if found is None:
            raise ValueError(f"there is no field '{path}'")
        below = Target(t.column.getField(found.name), found.dataType, path)
    elif isinstance(t.type, T.MapType):
        below = Target(F.element_at(t.column, F.lit(name)), t.type.valueType, path)
    elif isinstance(t.type, T.VariantType):
        below = Target(F.try_variant_get(t.column, f"$.{'.'.join(names)}", "variant"), T.VariantType(), path)
        return then(below, negated)
    else:
        raise ValueError(f"'{t.path}' has no field '{name}'")
    inner = _walk(names[1:], below, then, negated)
    return t.column.isNull() | inner if negated else t.column.isNotNull() & inner


def _field(path: str, value: Any, schema: T.StructType, get: Callable[[str], Column], negated: bool, id_column: str | None) -> Column:
    names = path.split(".")
    found = find_field(schema, names[0])
    if found is None and names[0] == "_id" and id_column:
        found = find_field(schema, id_column)
    if found is None:
        raise ValueError(f"there is no field '{path}'")
    root = Target(get(found.name), found.dataType, found.name)
    if isinstance(value, (Regex, re.Pattern)):
        tests = [("$regex", value)]
    elif isinstance(value, dict):
        tests = list(value.items())
    else:
        tests = [("$eq", value)]
    if not tests:
        raise NotImplementedError(f"an empty document for '{path}' is not supported")
    made = [_walk(names[1:], root, _test(op, v), negated) for op, v in tests]
    return reduce(Column.__or__ if negated else Column.__and__, made)


def _test(op: str, value: Any) -> Callable[[Target, bool], Column]:
    return lambda t, negated: _apply(op, t, value, negated)


LOGICAL = ("$and", "$or", "$nor")


def _document(doc: dict, schema: T.StructType, get: Callable[[str], Column], negated: bool, id_column: str | None) -> Column:
    made = []
    for name, value in doc.items():
        if name in LOGICAL:
            if not isinstance(value, (list, tuple)):
                raise NotImplementedError(f"{name} takes a list of documents")
            if not value:
                raise ValueError(f"{name} takes at least one document")
            inner = negated != (name == "$nor")
            parts = [_document(d, schema, get, inner, id_column) for d in value]
            any_of = (name != "$and") != inner  # De Morgan
            made.append(reduce(Column.__or__ if any_of else Column.__and__, parts))
        elif name.startswith("$"):
            raise NotImplementedError(f"operator '{name}' is not supported")
        else:
            made.append(_field(name, value, schema, get, negated, id_column))
    if not made:
        return F.lit(not negated)
    return reduce(Column.__or__ if negated else Column.__and__, made)


def translate(doc: dict, schema: T.StructType, id_column: str | None = None, negated: bool = False) -> Column:
    """The predicate of a filter document over rows of ``schema`` (negated: of its complement).
    ``_id`` stands for ``id_column``.  Unknown fields raise ValueError, operators without a
    translation NotImplementedError, both here and not when data are read."""
    return _document(doc, schema, lambda n: F.col(f"`{n}`"), negated, id_column)


def not_(condition: Any) -> dict:
    """The complement of a field condition ``{"f": condition}`` as the operator that says it:
    a value becomes ``$ne``; of a document with ``$or``, its ``$nor``."""
    if isinstance(condition, dict):
        if set(condition) == {"$or"}:
            return {"$nor": condition["$or"]}
        if set(condition) == {"$eq"}:
            return {"$ne": condition["$eq"]}
        return {"$nor": [condition]}
    return {"$ne": condition}


def stored_names(doc: dict, elements: dict[str, str]) -> dict:
    """The filter document with the stored element names in place of the attribute names at the start of its paths."""
    if not elements:
        return doc
    out = {}
    for name, value in doc.items():
        if name in LOGICAL and isinstance(value, (list, tuple)):
            value = [stored_names(d, elements) for d in value]
        elif not name.startswith("$"):
            first, dot, rest = name.partition(".")
            name = elements.get(first, first) + dot + rest
        if name in out:
            raise ValueError(f"'{name}' is named twice, by its attribute and its stored name")
        out[name] = value
    return out


# Types whose values are equal only if they filter alike, given their type.
_KEYED = (str, int, float, bool, bytes, type(None), datetime.datetime, datetime.date, datetime.timedelta, decimal.Decimal, uuid.UUID, Regex, re.Pattern)


def _key(value: Any) -> Any:
    """A key that only equal filter values share, in every place; TypeError for values that have none."""
    if isinstance(value, dict):
        return (dict, *((k, _key(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return (list, *map(_key, value))
    if type(value) not in _KEYED:
        raise TypeError(type(value).__name__)
    return (type(value), repr(value)) if isinstance(value, (float, datetime.datetime, decimal.Decimal)) else (type(value), value)


class FilterCache:
    """Translated filters by document and schema; the oldest goes first.  Documents with values other than
    plain Python ones, such as arrays or Columns, are translated anew each time."""

    def __init__(self, most: int = 1000):
        self.most, self.hits, self._made = most, 0, OrderedDict()

    def translate(self, doc: dict, schema: T.StructType, id_column: str | None = None) -> Column:
        try:
            key = (_key(doc), schema.json(), id_column)
        except TypeError:
            return translate(doc, schema, id_column)
        if key in self._made:
            self.hits += 1
            return self._made[key]
        made = translate(doc, schema, id_column)
        while len(self._made) >= max(1, self.most):
            self._made.popitem(last=False)
        self._made[key] = made
        return made


def complexity(doc: Any) -> int:
    """The number of elements of a filter document, at every depth."""
    if isinstance(doc, dict):
        return sum(1 + complexity(v) for v in doc.values())
    if isinstance(doc, (list, tuple)):
        return sum(complexity(v) for v in doc)
    return 0
