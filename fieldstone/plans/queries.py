"""The registered queries of the document engine, each with its SQL equivalent.

The given tables have neither nulls nor arrays of documents, so queries on them derive both: ``seg`` is
the market segment with one value turned to null, and ``orders`` with their ``lines`` as an array of structs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions import metrics
from fieldstone.operators import attachments, changes, diff
from fieldstone.operators.docset import DocSet, included_rows, include, missing
from fieldstone.plans.filters import Regex, not_, operator, translate
from fieldstone.plans.model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a nullable segment, a nested address and a nullable balance."""
    c = read(spark, sf_dir, "customer")
    seg = F.expr("nullif(c_mktsegment, 'BUILDING')")
    nation = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_nationkey").alias("nation"), seg.alias("seg")))
    return c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", seg.alias("seg"), nation.alias("address"))


CUSTOMERS = """(SELECT c_custkey, c_name, c_acctbal, c_mktsegment, nullif(c_mktsegment, 'BUILDING') AS seg,
    c_custkey % 3 <> 0 AS has_address, c_nationkey FROM customer) AS c"""


LINE = {"part": "l_partkey", "quantity": "l_quantity", "flag": "l_returnflag", "price": "l_extendedprice"}


def order_documents(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = tuple(LINE)) -> DataFrame:
    """Orders with their lines as an array of structs; null for orders without lines."""
    line = F.struct(*[F.col(LINE[f]).alias(f) for f in fields])
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey")


def orders_with(*fields: str):
    """Order documents whose lines have only these fields."""
    return lambda spark, sf_dir: order_documents(spark, sf_dir, fields)


def filtered(name: str, doc: dict, sql: str, source=customers, keep: tuple[str, ...] = ("c_custkey",), table: str = CUSTOMERS) -> None:
    """A query that filters by a document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return rows.filter(translate(doc, rows.schema)).select(*keep)

    query(name, f"SELECT {', '.join(keep)} FROM {table} WHERE {sql}")(run)


# -- filters: comparison, membership, logic

filtered("filter_match_all", {}, "true")
filtered("filter_eq_implicit", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'")
filtered("filter_eq", {"c_mktsegment": {"$eq": "MACHINERY"}}, "c_mktsegment = 'MACHINERY'")
filtered("filter_eq_null", {"seg": None}, "seg IS NULL")
filtered("filter_ne_nulls", {"seg": {"$ne": "MACHINERY"}}, "seg IS DISTINCT FROM 'MACHINERY'")
filtered("filter_ne_null", {"seg": {"$ne": None}}, "seg IS NOT NULL")
filtered("filter_not_value", {"seg": not_("MACHINERY")}, "seg IS DISTINCT FROM 'MACHINERY'")
filtered("filter_gt", {"c_custkey": {"$gt": 100}}, "c_custkey > 100")
filtered("filter_gte", {"c_custkey": {"$gte": 100}}, "c_custkey >= 100")
filtered("filter_lt", {"c_acctbal": {"$lt": 0}}, "c_acctbal < 0")
filtered("filter_lte", {"c_custkey": {"$lte": 500}}, "c_custkey <= 500")
filtered("filter_range_multi_op", {"c_acctbal": {"$gte": 0, "$lt": 2500}}, "c_acctbal >= 0 AND c_acctbal < 2500")
filtered("filter_in", {"seg": {"$in": ["MACHINERY", "FURNITURE"]}}, "seg IN ('MACHINERY', 'FURNITURE')")
filtered("filter_in_with_null", {"seg": {"$in": ["MACHINERY", None]}}, "seg = 'MACHINERY' OR seg IS NULL")
filtered("filter_in_empty", {"$or": [{"seg": {"$in": []}}, {"c_custkey": {"$lte": 10}}]}, "c_custkey <= 10")
filtered("filter_nin_nulls", {"seg": {"$nin": ["MACHINERY", "FURNITURE"]}}, "seg IS NULL OR seg NOT IN ('MACHINERY', 'FURNITURE')")
filtered("filter_nin_with_null", {"seg": {"$nin": ["MACHINERY", None]}}, "seg IS NOT NULL AND seg <> 'MACHINERY'")
filtered("filter_implicit_and", {"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 0}}, "c_mktsegment = 'BUILDING' AND c_acctbal > 0")
filtered("filter_and_or_nested", {"$and": [{"c_acctbal": {"$gt": 0}}, {"$or": [{"seg": "MACHINERY"}, {"c_custkey": {"$lt": 300}}]}]}, "c_acctbal > 0 AND (seg = 'MACHINERY' OR c_custkey < 300)")
filtered("filter_nor_nulls", {"$nor": [{"seg": "MACHINERY"}, {"c_acctbal": {"$lt": 0}}]}, "NOT coalesce(seg = 'MACHINERY', false) AND NOT coalesce(c_acctbal < 0, false)")
filtered("filter_nor_of_nor", {"$nor": [{"$nor": [{"seg": "MACHINERY"}]}]}, "coalesce(seg = 'MACHINERY', false)")
filtered("filter_not_or", not_({"$or": [{"seg": {"$in": ["MACHINERY"]}}, {"c_custkey": {"$gte": 900}}]}), "NOT coalesce(seg IN ('MACHINERY'), false) AND c_custkey < 900")

# -- filters: patterns and types

PARTS = "(SELECT p_partkey, p_name, p_brand FROM part) AS p"
parts = lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
filtered("filter_regex", {"p_name": {"$regex": "ring$"}}, "regexp_matches(p_name, 'ring$')", parts, ("p_partkey",), PARTS)
filtered("filter_regex_flags", {"p_name": Regex("^SMALL", "i")}, "regexp_matches(p_name, '^SMALL', 'i')", parts, ("p_partkey",), PARTS)
filtered("filter_regex_newlines", {"lines": Regex("^small$", "m")}, "list_contains(string_split(p_name, ' '), 'small')", lambda spark, sf_dir: parts(spark, sf_dir).withColumn("lines", F.translate("p_name", " ", "\n")), ("p_partkey",), PARTS)
filtered("filter_regex_free_spacing", {"p_name": Regex("^ small # the size", "x")}, "regexp_matches(p_name, '^small')", parts, ("p_partkey",), PARTS)
filtered("filter_regex_prefix", {"p_name": {"$regex": "^small"}}, "starts_with(p_name, 'small')", parts, ("p_partkey",), PARTS)
filtered("filter_regex_negated", {"$nor": [{"p_name": {"$regex": "ring"}}]}, "NOT regexp_matches(p_name, 'ring')", parts, ("p_partkey",), PARTS)
filtered("filter_regex_null", {"$nor": [{"seg": {"$regex": "A"}}]}, "NOT coalesce(regexp_matches(seg, 'A'), false)")
# Every event gets a field that is a number, a text, a truth value or an object.
events = lambda spark, sf_dir: read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json(F.expr("""concat('{"k":', CASE event_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN 'true' ELSE props END, '}')""")), "$.k", "variant").alias("k"))
EVENTS = "(SELECT event_id, event_id % 4 AS kind FROM events) AS e"
filtered("filter_type_variant", {"k": {"$type": ["int", "string"]}}, "kind IN (0, 1)", events, ("event_id",), EVENTS)
filtered("filter_type_variant_one", {"k": {"$type": "bool"}}, "kind = 2", events, ("event_id",), EVENTS)
filtered("filter_type_variant_negated", {"$nor": [{"k": {"$type": "string"}}]}, "kind <> 1", events, ("event_id",), EVENTS)
filtered("filter_type_static", {"seg": {"$type": "string"}}, "seg IS NOT NULL")
filtered("filter_type_static_negated", {"$nor": [{"seg": {"$type": "string"}}]}, "seg IS NULL")

# -- filters: paths and arrays

filtered("filter_nested_path", {"address.nation": {"$lt": 5}}, "has_address AND c_nationkey < 5")
filtered("filter_nested_ne", {"address.seg": {"$ne": "MACHINERY"}}, "has_address AND seg IS DISTINCT FROM 'MACHINERY'")
filtered("filter_nested_nin_negated", {"$nor": [{"address.seg": {"$nin": ["MACHINERY"]}}]}, "NOT has_address OR seg = 'MACHINERY'")
O = "(SELECT o_orderkey FROM orders) AS o"
one = lambda test: f"EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {test})"
filtered("filter_array_path_any", {"lines.flag": "R"}, one("l_returnflag = 'R'"), orders_with("flag"), ("o_orderkey",), O)
filtered("filter_array_path_ne", {"lines.flag": {"$ne": "N"}}, one("l_returnflag <> 'N'"), orders_with("flag"), ("o_orderkey",), O)
filtered("filter_array_path_negated", {"$nor": [{"lines.flag": "R"}]}, f"NOT {one('''l_returnflag = 'R' ''')}", orders_with("flag"), ("o_orderkey",), O)
filtered("filter_array_path_in", {"lines.part": {"$in": [1, 2, 3]}}, one("l_partkey IN (1, 2, 3)"), orders_with("part"), ("o_orderkey",), O)
filtered("filter_elem_match", {"lines": {"$elemMatch": {"quantity": {"$gt": 45}, "flag": "R"}}}, one("l_quantity > 45 AND l_returnflag = 'R'"), orders_with("quantity", "flag"), ("o_orderkey",), O)
filtered("filter_elem_match_or", {"lines": {"$elemMatch": {"$or": [{"quantity": {"$gte": 50}}, {"price": {"$lt": 1000}}]}}}, one("(l_quantity >= 50 OR l_extendedprice < 1000)"), orders_with("quantity", "price"), ("o_orderkey",), O)
filtered("filter_elem_match_negated", {"$nor": [{"lines": {"$elemMatch": {"quantity": {"$gt": 45}}}}]}, f"NOT {one('l_quantity > 45')}", orders_with("quantity"), ("o_orderkey",), O)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_documents(spark, sf_dir, ("flag",)).select("o_orderkey", F.transform("lines", lambda x: x["flag"]).alias("flags"))


filtered("filter_all", {"flags": {"$all": ["R", "N"]}}, f"{one('''l_returnflag = 'R' ''')} AND {one('''l_returnflag = 'N' ''')}", flagged, ("o_orderkey",), O)
filtered("filter_all_negated", {"$nor": [{"flags": {"$all": ["R", "N"]}}]}, f"NOT ({one('''l_returnflag = 'R' ''')} AND {one('''l_returnflag = 'N' ''')})", flagged, ("o_orderkey",), O)
filtered("filter_scalar_array_eq", {"flags": "A"}, one("l_returnflag = 'A'"), flagged, ("o_orderkey",), O)


@query("filter_lambda", "SELECT c_custkey FROM customer WHERE c_acctbal * 2 > 15000")
def filter_lambda(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return DocSet(rows, Model("customer", rows.schema, "c_custkey")).query(lambda d: d["c_acctbal"] * 2 > 15000).select("c_custkey")


@query("filter_by_batches", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 1")
def filter_by_batches(spark, sf_dir):
    """A vectorised Python predicate on whole batches."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return DocSet(rows, Model("customer", rows.schema, "c_custkey")).matching(lambda b: (b["c_acctbal"] > 0) & (b["c_custkey"] % 3 == 1)).select("c_custkey")


@operator("$ends")
def _ends(t, value, negated):
    """An own operator: the value ends with a text."""
    return t.column.isNull() | ~t.column.endswith(value) if negated else t.column.endswith(value)


filtered("filter_own_operator", {"c_name": {"$ends": "7"}}, "suffix(c_name, '7')")
filtered("filter_own_operator_negated", {"$nor": [{"seg": {"$ENDS": "Y"}}]}, "NOT coalesce(suffix(seg, 'Y'), false)")


@query("filter_complement", "SELECT CAST(count(*) AS BIGINT) AS rows_in_one FROM customer")
def filter_complement(spark, sf_dir):
    """Every row satisfies a filter or its complement, and none both."""
    rows = customers(spark, sf_dir)
    doc = {"$or": [{"seg": {"$gt": "F"}}, {"address.seg": {"$nin": ["MACHINERY"]}}, {"c_acctbal": {"$lt": 0}}]}
    yes, no = translate(doc, rows.schema), translate({"$nor": [doc]}, rows.schema)
    return rows.filter(yes).select("c_custkey").union(rows.filter(no).select("c_custkey")).agg(F.count_distinct("c_custkey").alias("rows_in_one"))


@query("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def filter_date_range(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.filter(translate({"o_orderdate": {"$gte": "1996-01-01", "$lt": "1996-07-01"}}, rows.schema)).select("o_orderkey")


# -- point loads, includes


@query("load_by_id", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def load_by_id(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return DocSet(rows, Model("orders", rows.schema, "o_orderkey")).load(77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("load_missing_id", "SELECT CAST(count(*) FILTER (WHERE o_orderkey = -5) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE o_orderkey = 77) AS BIGINT) AS there FROM orders")
def load_missing_id(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    orders = DocSet(rows, Model("orders", rows.schema, "o_orderkey"))
    number = lambda key, name: orders.load(key).agg(F.count(F.lit(1)).alias(name))
    return number(-5, "missing").crossJoin(number(77, "there"))  # one row each


@query("include_customer", """SELECT o_orderkey, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000""")
def include_customer(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    roots = orders.filter(translate({"o_totalprice": {"$gt": 100000}}, orders.schema))
    out = include(roots, "o_custkey", customer, "c_custkey")
    return out.filter(F.size("_included_o_custkey") == 1).select("o_orderkey", F.col("_included_o_custkey")[0]["c_name"].alias("customer"))


@query(
    "include_missing",
    """SELECT o_orderkey, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n, c_name AS customer
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey AND o_custkey % 5 <> 0""",
)
def include_missing(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("ref", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    out = include(orders, "ref", read(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_custkey")
    return out.select("o_orderkey", F.size("_included_ref").alias("n"), F.get("_included_ref", F.lit(0))["c_name"].alias("customer"))


@query(
    "include_two",
    """SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON s_suppkey % 7 = r_regionkey""",
)
def include_two(spark, sf_dir):
    roots = read(spark, sf_dir, "supplier").withColumn("r", (F.col("s_suppkey") % 7).cast("int"))
    out = include(roots, "s_nationkey", read(spark, sf_dir, "nation"), "n_nationkey")
    out = include(out, "r", read(spark, sf_dir, "region"), "r_regionkey")
    return out.select("s_suppkey", F.get("_included_s_nationkey", F.lit(0))["n_name"].alias("nation"), F.get("_included_r", F.lit(0))["r_name"].alias("region"))


@query(
    "include_array_fk",
    """SELECT o_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS n_parts, lowest FROM orders LEFT JOIN (
        SELECT l_orderkey, count(DISTINCT p_partkey) AS n, min(p_partkey) AS lowest
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def include_array_fk(spark, sf_dir):
    orders = order_documents(spark, sf_dir, ("part",)).withColumn("parts", F.transform("lines", lambda x: x["part"])).select("o_orderkey", "parts")
    out = include(orders, "parts", read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return out.select("o_orderkey", F.size("_included_parts").alias("n_parts"), F.get("_included_parts", F.lit(0))["p_partkey"].alias("lowest"))


@query("included_entities", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def included_entities(spark, sf_dir):
    roots = read(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return included_rows(roots, "o_custkey", read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


@query("anti_missing_ids", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def anti_missing_ids(spark, sf_dir):
    return missing(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").filter("c_acctbal > 5000"), "c_custkey").select("o_orderkey")


# -- change sets


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 4).cast("bigint").alias("Version"))


BASE = "(SELECT c_custkey, c_name, c_acctbal, CAST(c_custkey % 4 AS BIGINT) AS Version FROM customer)"
TOP = "(SELECT max(c_custkey) FROM customer)"


def staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, changes.ChangeSet]:
    """Deletes every 10th id, inserts every 7th anew (twice, the second wins) and new ids, updates every
    3rd: overlaps in all combinations."""
    base = versioned(spark, sf_dir)
    deletes = base.filter("c_custkey % 10 = 0").select("c_custkey")
    again = base.filter("c_custkey % 7 = 0").withColumn("c_name", F.lit("first")).withColumn(changes.SEQ, F.lit(1))
    final = base.filter("c_custkey % 7 = 0").withColumn("c_name", F.lit("second")).withColumn(changes.SEQ, F.lit(2))
    new = base.filter("c_custkey % 50 = 1").withColumn("c_custkey", -F.col("c_custkey")).withColumn(changes.SEQ, F.lit(3))
    updates = base.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)).withColumn(changes.SEQ, F.lit(4))
    return base, changes.resolve(deletes, again.unionByName(final).unionByName(new), updates, "c_custkey")


@query(
    "commit_precedence",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'second' ELSE c_name END AS c_name,
        CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN Version + 1 ELSE Version END AS Version
    FROM {BASE} WHERE c_custkey % 10 <> 0
    UNION ALL SELECT -c_custkey, c_name, c_acctbal, Version FROM {BASE} WHERE c_custkey % 50 = 1""",
)
def commit_precedence(spark, sf_dir):
    base, change = staged(spark, sf_dir)
    return changes.apply(base, change, "c_custkey", "Version")


@query("commit_last_wins", f"SELECT c_custkey, 'second' AS c_name FROM {BASE} WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0 UNION ALL SELECT -c_custkey, c_name FROM {BASE} WHERE c_custkey % 50 = 1")
def commit_last_wins(spark, sf_dir):
    return staged(spark, sf_dir)[1].inserts.select("c_custkey", "c_name")


def _none(base: DataFrame) -> DataFrame:
    return base.filter("false").withColumn(changes.SEQ, F.lit(0))


@query("commit_insert", f"SELECT * FROM {BASE} UNION ALL SELECT c_custkey + 1000000, 'new', c_acctbal, Version FROM {BASE} WHERE c_custkey % 9 = 0")
def commit_insert(spark, sf_dir):
    base = versioned(spark, sf_dir)
    rows = base.filter("c_custkey % 9 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000).withColumn("c_name", F.lit("new")).withColumn(changes.SEQ, F.lit(1))
    return changes.apply(base, changes.resolve(base.filter("false"), rows, _none(base), "c_custkey"), "c_custkey", "Version", strict_insert=True)


@query("commit_delete", f"SELECT * FROM {BASE} WHERE c_acctbal >= 0")
def commit_delete(spark, sf_dir):
    base = versioned(spark, sf_dir)
    return changes.apply(base, changes.resolve(base.filter("c_acctbal < 0"), _none(base), _none(base), "c_custkey"), "c_custkey", "Version")


@query("commit_update", f"SELECT c_custkey, c_name || '!' AS c_name, c_acctbal, Version + 1 AS Version FROM {BASE}")
def commit_update(spark, sf_dir):
    base = versioned(spark, sf_dir)
    rows = base.withColumn("c_name", F.concat("c_name", F.lit("!"))).withColumn(changes.SEQ, F.lit(1))
    return changes.apply(base, changes.resolve(base.filter("false"), _none(base), rows, "c_custkey"), "c_custkey", "Version")


@query("commit_partial_update", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_name END AS c_name, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN Version + 1 ELSE Version END AS Version FROM {BASE}")
def commit_partial_update(spark, sf_dir):
    """Only the changed field is taken from the new row."""
    base = versioned(spark, sf_dir)
    rows = base.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("x")).withColumn("c_acctbal", F.lit(0.0)).withColumn("changed", F.array(F.lit("c_name"))).withColumn(changes.SEQ, F.lit(1))
    return changes.apply(base, changes.resolve(base.filter("false"), _none(base), rows, "c_custkey"), "c_custkey", "Version")


@query("commit_upsert_unversioned", f"SELECT c_custkey, 'u' AS c_name, c_acctbal, Version FROM {BASE} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal, Version FROM {BASE} WHERE c_custkey % 2 <> 0 UNION ALL SELECT -1 - c_custkey, 'u', c_acctbal, Version FROM {BASE} WHERE c_custkey % 2 = 0")
def commit_upsert_unversioned(spark, sf_dir):
    base = versioned(spark, sf_dir)
    known = base.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("u"))
    rows = known.unionByName(known.withColumn("c_custkey", -1 - F.col("c_custkey"))).withColumn(changes.SEQ, F.lit(1))
    return changes.apply(base, changes.resolve(base.filter("false"), _none(base), rows, "c_custkey"), "c_custkey", None)


@query("commit_conflicts", f"SELECT c_custkey FROM {BASE} WHERE c_custkey % 5 = 0 UNION ALL SELECT -1 - c_custkey FROM {BASE} WHERE c_custkey % 11 = 0")
def commit_conflicts(spark, sf_dir):
    """Updates of another version, and of rows that are gone."""
    base = versioned(spark, sf_dir)
    stale = base.withColumn("Version", F.when(F.col("c_custkey") % 5 == 0, F.col("Version") + 1).otherwise(F.col("Version")))
    gone = base.filter("c_custkey % 11 = 0").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return changes.conflicts(base, stale.unionByName(gone), "c_custkey", "Version").select("c_custkey")


# -- diffs


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as documents with a map, an array and a nested struct; and an edited copy of them."""
    part = read(spark, sf_dir, "part")
    base = part.select(
        "p_partkey", "p_name", "p_size", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("tags"),
        F.when(F.col("p_partkey") % 2 == 0, F.array("p_size")).alias("sizes"), F.struct(F.col("p_type").alias("t"), F.struct("p_brand").alias("inner")).alias("nested"),
    )
    key = F.col("p_partkey")
    current = base.select(
        "p_partkey", F.when(key % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("p_name"), "p_size",
        F.map_from_entries(F.reverse(F.map_entries("tags"))).alias("tags"),
        F.coalesce(F.when(key % 6 == 0, F.array_append("sizes", F.lit(0))).otherwise(F.col("sizes")), F.array().cast("array<int>")).alias("sizes"),
        F.when(key % 7 == 0, F.col("nested").withField("inner.p_brand", F.lit("other"))).otherwise(F.col("nested")).alias("nested"),
    )
    return base, current


FIELDS = ["p_name", "p_size", "tags", "sizes", "nested"]


@query("diff_dirty", "SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 6 = 0 OR p_partkey % 7 = 0")
def diff_dirty(spark, sf_dir):
    return diff.dirty(*edited(spark, sf_dir), "p_partkey", FIELDS).select("p_partkey")


@query(
    "diff_changed_fields",
    """SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'p_name' END,
        CASE WHEN p_partkey % 6 = 0 THEN 'sizes' END, CASE WHEN p_partkey % 7 = 0 THEN 'nested' END) AS changed FROM part) WHERE changed <> ''""",
)
def diff_changed_fields(spark, sf_dir):
    out = diff.changed_fields(*edited(spark, sf_dir), "p_partkey", FIELDS)
    return out.select("p_partkey", F.array_join("changed", ",").alias("changed"))


@query("diff_change_documents", """SELECT p_partkey, '{"p_name":"' || p_name || '?"}' AS name_change FROM part WHERE p_partkey % 5 = 0""")
def diff_change_documents(spark, sf_dir):
    out = diff.change_documents(*edited(spark, sf_dir), "p_partkey", FIELDS)
    return out.filter(F.map_contains_key("changes", "p_name")).select("p_partkey", F.element_at("changes", "p_name").alias("name_change"))


@query("diff_map_order", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0")
def diff_map_order(spark, sf_dir):
    """All maps have another order, some another value too."""
    base, current = edited(spark, sf_dir)
    tags = F.transform_values("tags", lambda k, v: F.when((k == "type") & (F.col("p_partkey") % 4 == 0), F.concat(v, F.lit("?"))).otherwise(v))
    return diff.dirty(base, current.withColumn("tags", tags), "p_partkey", ["tags"]).select("p_partkey")


@query("diff_null_empty", "SELECT p_partkey FROM part WHERE p_partkey % 6 = 0")
def diff_null_empty(spark, sf_dir):
    return diff.dirty(*edited(spark, sf_dir), "p_partkey", ["sizes"]).select("p_partkey")


# -- ids, constraints, metrics


@query("assign_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'orders/' ELSE CAST(o_orderkey AS VARCHAR) END AS prefix, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 43 ELSE length(CAST(o_orderkey AS VARCHAR)) END AS INTEGER) AS size FROM orders")
def assign_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, F.lit("")).when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("Id"))
    made = Model("orders", rows.schema).with_ids(rows)
    new = F.col("o_orderkey") % 3 == 0
    return made.select("o_orderkey", F.when(new, F.substring("Id", 1, 7)).otherwise(F.col("Id")).alias("prefix"), F.length("Id").alias("size"))


@query("unique_violations", "SELECT seg, balance, CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, CAST(floor(c_acctbal / 10) AS BIGINT) AS balance FROM customer) WHERE seg IS NOT NULL GROUP BY seg, balance HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    rows = customers(spark, sf_dir).select("seg", F.floor(F.col("c_acctbal") / 10).alias("balance"))
    return changes.unique_violations(rows, ["seg", "balance"])


@query("filter_metrics", "SELECT CAST(5 AS INTEGER) AS complexity, CAST(count(*) AS BIGINT) AS matched FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_metrics(spark, sf_dir):
    rows, m = read(spark, sf_dir, "customer"), metrics.Metrics()
    doc = m.filter({"$and": [{"c_acctbal": {"$gt": 0}}, {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, {}]})
    return rows.filter(translate(doc, rows.schema)).agg(F.lit(int(m.total["filter_complexity"])).alias("complexity"), F.count(F.lit(1)).alias("matched"))


# -- attachments: every document's text as a blob, in chunks of 1000 bytes

PART = 1000


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("entity_id"), F.lit("body.txt").alias("name"), F.encode("text", "UTF-8").alias("data"), F.when(F.col("doc_id") % 2 == 0, F.lit("text/plain")).alias("content_type"))


@query("attachment_roundtrip", "SELECT 'documents/' || doc_id || '/body.txt' AS filename, md5(text) AS digest, true AS complete FROM documents")
def attachment_roundtrip(spark, sf_dir):
    b = blobs(spark, sf_dir)
    whole = attachments.reassembled(attachments.files_of(b, PART), attachments.chunks_of(b, PART))
    return whole.select("filename", F.md5("data").alias("digest"), "complete")


@query("attachment_chunks", f"SELECT doc_id, CAST(ceil(octet_length(encode(text)) / {PART}.0) AS BIGINT) AS chunks, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def attachment_chunks(spark, sf_dir):
    b = blobs(spark, sf_dir)
    own = attachments.chunks_of(b, PART).groupBy("files_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("data")).alias("size"))
    files = attachments.files_of(b, PART).select("_id", F.substring_index(F.col("metadata.EntityId"), "/", -1).cast("bigint").alias("doc_id"))
    return files.join(own, files["_id"] == own["files_id"]).select("doc_id", "chunks", "size")


@query("attachment_names", "SELECT 'body.txt' AS name, 'text/plain' AS content_type, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id = 42")
def attachment_names(spark, sf_dir):
    return attachments.names_of(attachments.files_of(blobs(spark, sf_dir), PART), "documents/42")


@query("attachment_replace_delete", "SELECT 'documents/' || doc_id AS entity, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE text END AS body FROM documents WHERE doc_id % 5 <> 0")
def attachment_replace_delete(spark, sf_dir):
    b = blobs(spark, sf_dir)
    number = F.substring_index("entity_id", "/", -1).cast("bigint")
    files, chunks = attachments.files_of(b, PART), attachments.chunks_of(b, PART)
    files, chunks = attachments.stored(files, chunks, b.filter(number % 3 == 0).withColumn("data", F.encode(F.lit("new"), "UTF-8")), PART)
    gone = b.filter(number % 5 == 0).select(attachments.file_name(F.col("entity_id"), F.col("name")).alias("filename"))
    whole = attachments.reassembled(*attachments.deleted(files, chunks, gone))
    return whole.select(F.col("metadata.EntityId").alias("entity"), F.decode("data", "UTF-8").alias("body"))


@query("attachment_repeated_names", "SELECT 'source/' || source AS entity, CAST(max(octet_length(encode(text))) AS BIGINT) AS size, true AS complete FROM documents GROUP BY source")
def attachment_repeated_names(spark, sf_dir):
    """One name per source, so of each source's texts the longest is stored."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("source/"), "source").alias("entity_id"), F.lit("body.txt").alias("name"), F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("content_type"))
    none = d.filter("false")
    whole = attachments.reassembled(*attachments.stored(attachments.files_of(none, PART), attachments.chunks_of(none, PART), d, PART))
    return whole.select(F.col("metadata.EntityId").alias("entity"), F.length("data").cast("bigint").alias("size"), "complete")


@query("attachment_null_data", "SELECT 'documents/' || doc_id AS entity, CAST(CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(text)) ELSE 0 END AS BIGINT) AS size, true AS complete FROM documents")
def attachment_null_data(spark, sf_dir):
    b = blobs(spark, sf_dir).withColumn("data", F.when(F.col("content_type").isNotNull(), F.col("data")))
    whole = attachments.reassembled(attachments.files_of(b, PART), attachments.chunks_of(b, PART))
    return whole.select(F.col("metadata.EntityId").alias("entity"), F.col("length").alias("size"), "complete")


@query("filter_element_names", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def filter_element_names(spark, sf_dir):
    """Attribute names in the filter, stored names in the files."""
    rows = read(spark, sf_dir, "customer")
    model = Model("customer", rows.schema, "c_custkey", elements={"Balance": "c_acctbal", "Segment": "c_mktsegment"})
    return DocSet(rows, model).query({"$and": [{"Balance": {"$gt": 0}}, {"Segment": {"$ne": "BUILDING"}}]}).select("c_custkey")


@query("flagship", """SELECT o_orderkey, c_name AS customer, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND o_orderstatus <> 'F' AND c_acctbal IS NOT NULL""")
def flagship(spark, sf_dir):
    """A filter document over orders, then the customers they refer to."""
    orders = read(spark, sf_dir, "orders")
    roots = orders.filter(translate({"o_totalprice": {"$gt": 50000}, "$nor": [{"o_orderstatus": "F"}]}, orders.schema)).select("o_orderkey", "o_custkey")
    out = include(roots, "o_custkey", read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    one = F.get("_included_o_custkey", F.lit(0))
    return out.filter(F.size("_included_o_custkey") > 0).select("o_orderkey", one["c_name"].alias("customer"), one["c_acctbal"].alias("c_acctbal"))
