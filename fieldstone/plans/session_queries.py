"""Queries that run whole units of work over the given tables: stage, save to a store, read back.

Each has its own store below the shared folder, removed when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.functions.metrics import Metrics
from fieldstone.operators.changes import ConcurrencyError
from fieldstone.operators.constraints import Index, UniqueError
from fieldstone.operators.session import Session
from fieldstone.sources.catalog import Context
from fieldstone.sources.store import StaleSnapshotError, Store, shared_root

from .model import Conventions, Model
from .queries import query, read

CUSTOMER = "(SELECT c_custkey, c_name, c_acctbal, c_nationkey, CAST(1 AS BIGINT) AS Version FROM customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", F.lit(1).cast("bigint").alias("Version"))


def opened(spark: SparkSession, sf_dir: str, conventions: Conventions = Conventions(), fill: bool = True, **more) -> Session:
    """A session over customers and nations; with ``fill`` both are saved in a first commit."""
    rows, nations = customers(spark, sf_dir), read(spark, sf_dir, "nation")
    models = [
        Model("customers", rows.schema, "c_custkey", references={"c_nationkey": "nations"}, conventions=conventions),
        Model("nations", nations.schema, "n_nationkey", conventions=conventions),
    ]
    s = Session(Store(spark, shared_root(spark)).temporary(), models, conventions, **more)
    if fill:
        s.insert("customers", rows)
        s.insert("nations", nations)
        s.save()
    return s


def another(s: Session) -> Session:
    """A second session on the same store."""
    return Session(s.store, s.models.values(), s.conventions, s.indexes)


@query("session_insert_save", f"SELECT * FROM {CUSTOMER} UNION ALL SELECT -1, 'one', 1.5, 3, 1")
def session_insert_save(spark, sf_dir):
    """Inserts of many rows and of one, read back by a new session."""
    s = opened(spark, sf_dir, fill=False)
    s.insert("customers", customers(spark, sf_dir))
    s.store_one("customers", {"c_custkey": -1, "c_name": "one", "c_acctbal": 1.5, "c_nationkey": 3, "Version": 1})
    s.save()
    return another(s).rows("customers")


@query("session_update_versions", f"SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN Version + 1 ELSE Version END AS Version FROM {CUSTOMER}")
def session_update_versions(spark, sf_dir):
    s = opened(spark, sf_dir)
    s.update("customers", s.base("customers").filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)))
    s.save()
    return another(s).rows("customers")


@query("session_edit_entities", f"SELECT c_custkey, CASE WHEN c_custkey IN (7, 8) THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal, c_nationkey, CASE WHEN c_custkey IN (7, 8) THEN Version + 1 ELSE Version END AS Version FROM {CUSTOMER}")
def session_edit_entities(spark, sf_dir):
    """Rows loaded by id and found by a filter, edited in place; one is loaded and left as it is."""
    s = opened(spark, sf_dir)
    for entity in (s.load("customers", 7), *s.find("customers", {"c_custkey": {"$in": [7, 8]}})):
        entity["c_name"] = entity["c_name"].rstrip("!") + "!"
    s.load("customers", 9)
    s.save()
    return another(s).rows("customers")


@query("session_reads_its_writes", f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name FROM {CUSTOMER} WHERE c_custkey % 10 <> 0 AND c_custkey <> 11")
def session_reads_its_writes(spark, sf_dir):
    """Nothing is saved: the session's rows are the snapshot with what is staged."""
    s = opened(spark, sf_dir)
    s.delete("customers", s.base("customers").filter("c_custkey % 10 = 0").select("c_custkey"))
    s.update("customers", s.base("customers").filter("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")))
    s.delete_one("customers", 11)
    return s.rows("customers").select("c_custkey", "c_name")


@query("session_abort", f"SELECT * FROM {CUSTOMER}")
def session_abort(spark, sf_dir):
    s = opened(spark, sf_dir)
    with another(s) as t:
        t.load("customers", 5)["c_name"] = "lost"
        t.delete("customers", t.base("customers").select("c_custkey"))
    return another(s).rows("customers")


@query("session_precedence", f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_name END AS c_name FROM {CUSTOMER} WHERE c_custkey % 10 <> 0")
def session_precedence(spark, sf_dir):
    """Per id a delete wins over an insert, that over an update, the last insert over the first; in one commit."""
    s = opened(spark, sf_dir)
    base = s.base("customers")
    s.delete("customers", base.filter("c_custkey % 10 = 0").select("c_custkey"))
    for name in ("first", "second"):
        s.insert("customers", base.filter("c_custkey % 7 = 0").withColumn("c_name", F.lit(name)))
    s.update("customers", base.filter("c_custkey % 3 = 0").withColumn("c_name", F.lit("updated")))
    s.save()
    return another(s).rows("customers").select("c_custkey", "c_name")


@query("session_several_saves", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || 'ab' ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN Version + 2 ELSE Version END AS Version FROM {CUSTOMER} WHERE c_custkey % 9 <> 0")
def session_several_saves(spark, sf_dir):
    """One session goes on after each of its saves; then the table's folders are made one."""
    s = opened(spark, sf_dir)
    for letter in "ab":
        s.update("customers", s.base("customers").filter("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit(letter))))
        s.save()
    s.delete("customers", s.base("customers").filter("c_custkey % 9 = 0").select("c_custkey"))
    s.save()
    s.store.fold("customers")
    return another(s).rows("customers").select("c_custkey", "c_name", "Version")


@query("session_pinned_snapshot", f"SELECT c_custkey, c_name AS before, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS after FROM {CUSTOMER}")
def session_pinned_snapshot(spark, sf_dir):
    """A session that was opened before another's save still reads its own snapshot."""
    s = opened(spark, sf_dir)
    early = another(s)
    s.delete("customers", s.base("customers").filter("c_custkey % 5 = 0").select("c_custkey"))
    s.save()
    late = another(s).rows("customers").select("c_custkey", F.col("c_name").alias("after"))
    return early.rows("customers").select("c_custkey", F.col("c_name").alias("before")).join(late, "c_custkey", "left")


@query("session_conflict_report", f"SELECT c_custkey FROM {CUSTOMER} WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 OR c_custkey % 2 = 0 AND c_custkey % 11 = 0")
def session_conflict_report(spark, sf_dir):
    """All updates of rows that another session changed or deleted meanwhile, read after the failed save."""
    s = opened(spark, sf_dir)
    late = another(s)
    late.update("customers", late.base("customers").filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("late")))
    s.update("customers", s.base("customers").filter("c_custkey % 3 = 0").withColumn("c_name", F.lit("early")))
    s.delete("customers", s.base("customers").filter("c_custkey % 11 = 0").select("c_custkey"))
    s.save()
    try:
        late.save()
    except ConcurrencyError as error:
        return error.rows
    raise AssertionError("the save went through")


@query("session_failed_save_leaves_nothing", f"SELECT c_custkey, c_name FROM {CUSTOMER} UNION ALL SELECT -2 - n_nationkey, n_name FROM nation")
def session_failed_save_leaves_nothing(spark, sf_dir):
    """A conflict in one collection, a broken unique index, and a lost race publish nothing of any collection."""
    s = opened(spark, sf_dir, indexes=[Index("nations", ("n_name",), unique=True)])
    late, stale = another(s), another(s)
    changed = lambda t, name: t.update("customers", t.base("customers").withColumn("c_name", F.lit(name)))
    s.update("customers", s.base("customers"))
    s.save()
    changed(late, "late")
    late.delete("nations", late.base("nations").select("n_nationkey"))
    s.insert("nations", s.base("nations").withColumn("n_nationkey", F.col("n_nationkey") + 1000))
    changed(s, "twice")
    staged = stale.store.stage("customers", stale.base("customers").limit(1), "c_custkey")
    for action, error in ((late.save, ConcurrencyError), (s.save, UniqueError), (lambda: stale.store.publish({"customers": staged}, stale.commit), StaleSnapshotError)):
        try:
            action()
        except error:
            continue
        raise AssertionError("the save went through")
    after = another(s)
    return after.rows("customers").select("c_custkey", "c_name").union(after.rows("nations").select(-2 - F.col("n_nationkey"), "n_name"))


@query("session_upsert_unversioned", f"SELECT c_custkey, 'u' AS c_name, Version FROM {CUSTOMER} WHERE c_custkey % 2 = 0 UNION ALL SELECT -1 - c_custkey, 'u', Version FROM {CUSTOMER} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, Version FROM {CUSTOMER} WHERE c_custkey % 2 = 1")
def session_upsert_unversioned(spark, sf_dir):
    s = opened(spark, sf_dir, Conventions(version_attribute=None))
    known = s.base("customers").filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("u"))
    s.update("customers", known.unionByName(known.withColumn("c_custkey", -1 - F.col("c_custkey"))))
    s.save()
    return another(s).rows("customers").select("c_custkey", "c_name", "Version")


@query("session_delete_one_now", f"SELECT c_custkey FROM {CUSTOMER} WHERE c_custkey NOT IN (3, 4, 5)")
def session_delete_one_now(spark, sf_dir):
    """A delete in a commit of its own, one of a loaded row, one of an untracked insert's id."""
    s = opened(spark, sf_dir)
    s.delete_now("customers", 3)
    t = another(s)
    t.delete_one("customers", t.load("customers", 4))
    t.delete_one("customers", 5)
    t.store_one("customers", {"c_custkey": -9, "c_name": "never", "c_acctbal": 0.0, "c_nationkey": 1, "Version": 1})
    t.untrack("customers", -9)
    t.save()
    return another(t).rows("customers").select("c_custkey")


@query("session_tracked_includes", "SELECT c_custkey, n_name AS nation, 0 AS reads FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900")
def session_tracked_includes(spark, sf_dir):
    """Found customers are entities, and their nations load from the identity map: no load is recorded."""
    metrics = Metrics()
    s = opened(spark, sf_dir, metrics=metrics)
    found = s.find("customers", {"c_acctbal": {"$gt": 9900}}, include=["c_nationkey"])
    rows = [(c["c_custkey"], s.load("nations", c["c_nationkey"])["n_name"], metrics.count["load_seconds"]) for c in found]
    return spark.createDataFrame(rows, "c_custkey long, nation string, reads int")


@query("session_attachments", "SELECT 'documents/' || doc_id AS entity, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE text END AS body FROM documents WHERE doc_id % 5 <> 0")
def session_attachments(spark, sf_dir):
    """Blobs stored in one commit, then replaced, deleted, and, by a session that is left, all deleted."""
    s = Session(Store(spark, shared_root(spark)).temporary(), [])
    d = read(spark, sf_dir, "documents")
    blobs = d.select(F.concat(F.lit("documents/"), "doc_id").alias("entity_id"), F.lit("body.txt").alias("name"), F.encode("text", "UTF-8").alias("data"), F.lit("text/plain").alias("content_type"), "doc_id")
    s.attachments("texts").store_all(blobs)
    s.save()
    a = s.attachments("texts")
    a.store_all(blobs.filter("doc_id % 3 = 0").withColumn("data", F.encode(F.lit("new"), "UTF-8")))
    a.delete_all(blobs.filter("doc_id % 5 = 0").select(F.concat_ws("/", "entity_id", "name").alias("filename")))
    s.save()
    with Session(s.store, []) as t:
        t.attachments("texts").delete_all(blobs.select(F.concat_ws("/", "entity_id", "name").alias("filename")))
    return Session(s.store, []).attachments("texts").all().select(F.col("metadata.EntityId").alias("entity"), F.decode("data", "UTF-8").alias("body"))


@query("session_attach", f"SELECT c_custkey, CASE c_custkey WHEN 12 THEN 'attached' ELSE c_name END AS c_name, Version + CASE c_custkey WHEN 12 THEN 1 ELSE 0 END AS Version FROM {CUSTOMER}")
def session_attach(spark, sf_dir):
    """A row that came from elsewhere is attached: only its later edit is saved."""
    s = opened(spark, sf_dir)
    known = s.base("customers").filter("c_custkey IN (12, 13)").collect()
    for row in known:
        s.attach("customers", row.asDict())
    s.tracked("customers", 12)["c_name"] = "attached"
    s.save()
    return another(s).rows("customers").select("c_custkey", "c_name", "Version")


@query("session_best_effort", f"SELECT c_custkey, 'saved' AS name FROM {CUSTOMER} UNION ALL SELECT -1 - n_nationkey, n_name FROM nation")
def session_best_effort(spark, sf_dir):
    """Without atomic publishing the first collection is saved although the second one's unique index is broken."""
    s = opened(spark, sf_dir, Conventions(atomic=False), indexes=[Index("nations", ("n_name",), unique=True)])
    s.update("customers", s.base("customers").withColumn("c_name", F.lit("saved")))
    s.insert("nations", s.base("nations").withColumn("n_nationkey", F.col("n_nationkey") + 1000))
    try:
        s.save()
    except UniqueError:
        after = another(s)
        return after.rows("customers").select("c_custkey", F.col("c_name").alias("name")).union(after.rows("nations").select(-1 - F.col("n_nationkey"), "n_name"))
    raise AssertionError("the save went through")


@query("session_ignored_fields", f"SELECT c_custkey, CASE c_custkey WHEN 21 THEN 0.5 ELSE c_acctbal END AS c_acctbal, c_name FROM {CUSTOMER}")
def session_ignored_fields(spark, sf_dir):
    """Edits of untracked fields are not saved."""
    s = opened(spark, sf_dir)
    t = Session(s.store, [Model("customers", s.models["customers"].schema, "c_custkey", ignored=("c_name",))])
    t.load("customers", 20)["c_name"] = "never"
    t.load("customers", 21)["c_acctbal"] = 0.5
    t.save()
    return another(s).rows("customers").select("c_custkey", "c_acctbal", "c_name")


@query("session_made_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'orders/' ELSE CAST(o_orderkey AS VARCHAR) END AS prefix, true AS same FROM orders")
def session_made_ids(spark, sf_dir):
    """Ids made while saving are the ones that are stored: two reads give the same."""
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("Id"), "o_orderkey")
    s = Session(Store(spark, shared_root(spark)).temporary(), [Model("orders", rows.schema)])
    s.insert("orders", rows)
    s.save()
    again = another(s).rows("orders").select("o_orderkey", F.col("Id").alias("again"))
    prefix = F.when(F.col("o_orderkey") % 3 == 0, F.substring("Id", 1, 7)).otherwise(F.col("Id"))
    return s.rows("orders").join(again, "o_orderkey").select("o_orderkey", prefix.alias("prefix"), (F.col("Id") == F.col("again")).alias("same"))


@query("context_files_and_includes", "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2 WHERE s_acctbal > 0")
def context_files_and_includes(spark, sf_dir):
    """Collections by name, one of them read through another connector, and an include by the model's reference."""
    copy = f"{shared_root(spark)}-nation"
    Store(spark, copy).temporary()
    read(spark, sf_dir, "nation").filter("n_regionkey <> 2").write.json(copy)
    ctx = Context(spark)
    ctx.from_files(copy, "n_nationkey", name="nations", format="json")
    suppliers = read(spark, sf_dir, "supplier")
    ctx.register(Model("suppliers", suppliers.schema, "s_suppkey", references={"s_nationkey": "nations"}), lambda spark: read(spark, sf_dir, "supplier"))
    rows = ctx.query("suppliers", {"s_acctbal": {"$gt": 0}}).include("s_nationkey").rows()
    return rows.select("s_suppkey", F.get("_included_s_nationkey", F.lit(0))["n_name"].alias("nation"))
