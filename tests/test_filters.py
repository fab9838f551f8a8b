"""The filter language against a plain evaluator, what it refuses, and what reaches the scan."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone.plans.filters import FilterCache, Regex, complexity, not_, operator, stored_names, translate

BOOK = "title string, pages int, topics array<string>"
BOOKS = [
    ("Tidal maps", 120, ["sea", "maps"]), ("tidal Charts", 64, []), ("Stone walls", 64, None), ("Salt", None, ["sea"]), (None, 311, [None, "maps"]),
    ("Stone bridges", 311, ["maps", "rivers", "sea"]), ("Rain", 0, ["rivers", None]), ("", -5, ["sea", "sea"]),
]


def books(spark):
    return spark.createDataFrame(BOOKS, BOOK)


def one(op, value, x):
    """An operator on a single value."""
    if op in ("$ne", "$nin"):
        return not one({"$ne": "$eq", "$nin": "$in"}[op], value, x)
    if op == "$eq":
        return x == value and type(x) is type(value) if value is None or x is None else x == value
    if op == "$in":
        return any(one("$eq", v, x) for v in value)
    if x is None or value is None:
        return False
    if op == "$regex":
        r = value if isinstance(value, Regex) else Regex(value)
        return re.search(r.pattern, x, re.I if "i" in r.flags else 0) is not None
    if op == "$type":
        return {"string": str, "int": int}.get(value) is type(x)
    return {"$gt": x > value, "$gte": x >= value, "$lt": x < value, "$lte": x <= value}[op]


def holds(doc, row):
    """A filter document on a row, by the rules as the README states them."""
    for name, value in doc.items():
        if name in ("$and", "$or", "$nor"):
            got = [holds(d, row) for d in value]
            ok = all(got) if name == "$and" else any(got) == (name == "$or")
        else:
            tests = {"$regex": value} if isinstance(value, Regex) else value if isinstance(value, dict) else {"$eq": value}
            x = row[name.lower()]
            if name != "topics":
                ok = all(one(op, v, x) for op, v in tests.items())
            else:
                x = x or []  # a null array has no element; $all of nothing holds for it too
                ok = all(all(any(one("$eq", w, y) for y in x) for w in v) if op == "$all" else any(one(op, v, y) for y in x) for op, v in tests.items())
        if not ok:
            return False
    return True


def random_document(rng, depth=2):
    if depth and rng.random() < 0.5:
        return {rng.choice(("$and", "$or", "$nor")): [random_document(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    titles, pages, topics = ("Salt", "Rain", "Stone walls", "", None), (0, 64, 120, 311, 100.5), ("sea", "maps", "rivers", "fire")
    kind = rng.randrange(9)
    return [
        lambda: {"title": rng.choice(titles)},
        lambda: {"title": {rng.choice(("$ne", "$eq")): rng.choice(titles)}},
        lambda: {"title": {rng.choice(("$in", "$nin")): rng.sample(titles, rng.randint(0, 3))}},
        lambda: {"title": rng.choice((Regex("^stone", "i"), Regex("a"), {"$regex": "^Stone"}, {"$regex": "s$"}))},
        lambda: {"pages": {rng.choice(("$gt", "$gte", "$lt", "$lte")): rng.choice(pages)}},
        lambda: {"Pages": {"$gte": rng.choice(pages), "$lt": rng.choice(pages)}},
        lambda: {"topics": {"$all": rng.sample((*topics, None), rng.randint(0, 2))}},
        lambda: {"topics": rng.choice((rng.choice(topics), {"$ne": rng.choice(topics)}, {"$in": rng.sample(topics, 2)}))},
        lambda: {"title": rng.choice(titles), "pages": {"$type": rng.choice(("int", "string"))}},
    ][kind]()


def test_against_a_plain_evaluator(spark):
    rng = random.Random(11)
    docs = [{}, {"pages": {"$gt": None}}, {"title": not_("Salt")}, not_({"$or": [{"title": "Salt"}, {"pages": 64}]})]
    docs += [random_document(rng) for _ in range(250)]
    rows = books(spark)
    tests = [F.coalesce(translate(d, rows.schema, negated=n), F.lit(False)) for d in docs for n in (False, True)]
    names = [f.name for f in rows.schema]
    got = rows.select(*names, F.array(*tests).alias("got")).collect()
    mixed = 0
    for i, doc in enumerate(docs):
        want = [holds(doc, r) for r in got]
        assert [r.got[2 * i] for r in got] == want, doc
        assert [r.got[2 * i + 1] for r in got] == [not w for w in want], doc  # the complement
        mixed += len(set(want)) == 2
    assert mixed > 120


@pytest.mark.parametrize(
    "doc, error",
    [
        ({"pages": {"$exists": True}}, NotImplementedError),
        ({"pages": {"$mod": [2, 0]}}, NotImplementedError),
        ({"nothing": 1}, ValueError),
        ({"pages": {"$all": [64]}}, TypeError),
        ({"title": {"$regex": "a", "$options": "i"}}, NotImplementedError),
        ({"title": Regex("a", "q")}, NotImplementedError),
        ({"title": {"$type": "decimal128"}}, NotImplementedError),
        ({"$or": []}, ValueError),
        ({"$and": {"title": "x"}}, NotImplementedError),
        ({"$where": "1"}, NotImplementedError),
        ({"topics": {"$elemMatch": {"$gt": 5}}}, ValueError),
        ({"title.first": "x"}, ValueError),
    ],
)
def test_refused_at_translation(spark, doc, error):
    with pytest.raises(error):
        translate(doc, books(spark).schema)


def test_nested_paths_and_null_parents(spark):
    rows = spark.createDataFrame([(1, ("Lima",)), (2, ("Oslo",)), (3, (None,)), (4, None)], "Id int, printed struct<place: string>")
    ids = lambda doc: sorted(r.Id for r in rows.filter(translate(doc, rows.schema, "Id")).collect())
    assert ids({"printed.place": "Lima"}) == [1]
    assert ids({"printed.place": {"$ne": "Lima"}}) == [2, 3]
    assert ids({"$nor": [{"printed.place": {"$ne": "Lima"}}]}) == [1, 4]
    assert ids({"printed.place": {"$nin": ["Lima"]}}) == [2, 3]
    assert ids({"printed.place": None}) == [3]
    assert ids({"_id": 2}) == [2]
    with pytest.raises(NotImplementedError):
        translate({"printed": {"place": "Lima"}}, rows.schema)


def test_arrays_of_documents(spark):
    data = [("a", [("sand", 2, 9.5), ("clay", 3, 5.0)]), ("b", [("chalk", 8, 12.0)]), ("c", [("flint", 8, 9.5)]), ("d", []), ("e", None)]
    rows = spark.createDataFrame(data, "Id string, layers array<struct<soil: string, depth: int, age: double>>")
    ids = lambda doc: sorted(r.Id for r in rows.filter(translate(doc, rows.schema)).collect())
    assert ids({"layers": {"$elemMatch": {"soil": "sand"}}}) == ["a"]
    assert ids({"layers": {"$elemMatch": {"depth": {"$gt": 7}, "age": {"$lt": 10}}}}) == ["c"]
    assert ids({"layers": {"$elemMatch": {"$or": [{"soil": "sand"}, {"age": {"$gt": 10}}]}}}) == ["a", "b"]
    assert ids({"$nor": [{"layers": {"$elemMatch": {"soil": "sand"}}}]}) == ["b", "c", "d", "e"]
    assert ids({"layers.soil": {"$in": ["flint", "sand"]}}) == ["a", "c"]
    assert ids({"layers.soil": {"$ne": "sand"}}) == ["a", "b", "c"]


def test_dynamic_types_maps_dates_and_nan(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, parse_json('30')), (2, parse_json('\"x\"')), (3, parse_json('{\"a\": 1}')), (4, parse_json('null')), (5, NULL) AS t(Id, Metadata)")
    ids = lambda r, doc: sorted(x.Id for x in r.filter(translate(doc, r.schema)).collect())
    assert ids(rows, {"Metadata": {"$type": "int"}}) == [1]
    assert ids(rows, {"Metadata": {"$type": ["string", "int"]}}) == [1, 2]
    assert ids(rows, {"$nor": [{"Metadata": {"$type": "int"}}]}) == [2, 3, 4, 5]
    assert ids(rows, {"Metadata.a": {"$type": "long"}}) == [3]
    other = spark.createDataFrame([(1, {"k": "v"}, float("nan"), datetime.datetime(2024, 5, 1)), (2, None, 2.0, datetime.datetime(2025, 5, 1))], "Id int, M map<string,string>, D double, T timestamp_ntz")
    assert ids(other, {"M.k": "v"}) == [1]
    assert ids(other, {"D": {"$gt": 1}}) == [2]
    assert ids(other, {"$nor": [{"D": {"$gt": 1}}]}) == [1]
    assert ids(other, {"T": {"$gte": "2025-01-01"}}) == [2]
    assert ids(other, {"T": {"$lt": datetime.datetime(2025, 1, 1)}}) == [1]


def test_plans_push_down(spark, tmp_path):
    books(spark).write.parquet(f"{tmp_path}/p")
    rows = spark.read.parquet(f"{tmp_path}/p")
    doc = {"$nor": [{"title": "Salt"}, {"pages": {"$lt": 20}}], "title": {"$regex": "^S"}}
    plan = rows.filter(translate(doc, rows.schema))._jdf.queryExecution().toString()
    assert "StringStartsWith(title,S)" in plan and "EqualNullSafe(title,Salt)" in plan and "GreaterThanOrEqual(pages,20)" in plan


def test_own_operator_and_complexity(spark):
    rows = books(spark)

    @operator("$longer")
    def longer(t, value, negated):
        hit = F.coalesce(F.length(t.column) > value, F.lit(False))
        return ~hit if negated else hit

    assert [r.title for r in rows.filter(translate({"title": {"$longer": 12}}, rows.schema)).collect()] == ["Stone bridges"]
    assert complexity({"$and": [{"a": 1}, {"b": {"$gt": 1}}]}) == 4


def test_cache_tells_documents_apart(spark):
    schema, cache = books(spark).schema, FilterCache(2)
    for doc in ({"pages": 1}, {"pages": 1}, {"pages": 2}, {"pages": 3}, {"pages": 1}):
        cache.translate(doc, schema)
    assert cache.hits == 1
    numbers, cache = spark.range(3000), FilterCache()
    for low, high in ((0, 2000), (1990, 3990)):  # long arrays look alike when printed
        values = np.arange(low, high)
        values[1000] = values[0]
        assert numbers.filter(cache.translate({"id": {"$in": values.tolist()}}, numbers.schema)).count() == len(set(values.tolist()) & set(range(3000)))
        assert numbers.filter(cache.translate({"id": {"$in": values}}, numbers.schema)).count() == len(set(values.tolist()) & set(range(3000)))
    a, b = (cache.translate({"pages": v}, schema) for v in (1, True))
    assert a is not b and cache.translate({"pages": 1}, schema) is a


def test_attribute_names():
    doc = {"$or": [{"Title": "x"}, {"Place.City": 1}], "pages": {"$gt": 1}}
    assert stored_names(doc, {"Title": "title", "Place": "printed"}) == {"$or": [{"title": "x"}, {"printed.City": 1}], "pages": {"$gt": 1}}
    with pytest.raises(ValueError):
        stored_names({"Title": 1, "title": 2}, {"Title": "title"})
