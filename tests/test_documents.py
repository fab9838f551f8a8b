"""Includes, change sets, diffs, sessions, attachments."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.functions.metrics import Metrics
from fieldstone.operators import attachments as at
from fieldstone.operators import changes as ch
from fieldstone.operators import diff
from fieldstone.operators.constraints import Index, Indexes, UniqueError, lay_out
from fieldstone.operators.docset import include, included_rows
from fieldstone.operators.session import Session
from fieldstone.plans.model import Conventions, Model
from fieldstone.sources.catalog import Context
from fieldstone.sources.store import StaleSnapshotError, Store

PERSON = T.StructType.fromJson(T.StructType([T.StructField("Id", T.StringType()), T.StructField("Name", T.StringType()), T.StructField("Version", T.LongType())]).jsonValue())
PLAIN = Conventions(version_attribute=None)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_include_scalar_array_and_missing(spark):
    customers = spark.createDataFrame([("c1", "Robin"), ("c2", "Crow")], "Id string, Name string")
    orders = spark.createDataFrame([("o1", "c1", ["c2", "c1", "c2"]), ("o2", "zz", []), ("o3", None, None)], "Id string, CustomerId string, CustomerIds array<string>")
    one = {r.Id: [x.Name for x in r._included_CustomerId] for r in include(orders, "CustomerId", customers, "Id").collect()}
    assert one == {"o1": ["Robin"], "o2": [], "o3": []}
    many = {r.Id: [x.Name for x in r._included_CustomerIds] for r in include(orders, "CustomerIds", customers, "Id").collect()}
    assert many == {"o1": ["Robin", "Crow"], "o2": [], "o3": []}
    nameless = orders.withColumn("Id", F.lit(None).cast("string"))
    assert sorted(len(r._included_CustomerIds) for r in include(nameless, "CustomerIds", customers, "Id").collect()) == [0, 0, 2]
    assert rows_of(included_rows(orders, "CustomerId", customers, "Id")) == [("c1", "Robin")]


def test_include_of_arrays_whose_order_changes(spark):
    """As after a shuffle, each computation of the roots may give an array in another order."""
    shuffled = F.udf(lambda n: random.sample(range(n), n), "array<long>").asNondeterministic()
    roots, foreign = spark.range(40, 60).withColumn("refs", shuffled("id")), spark.range(100).toDF("key")
    assert all(r._included_refs == [(k,) for k in range(r.id)] for r in include(roots, "refs", foreign, "key").collect())


def test_context_query_with_includes(spark):
    ctx = Context(spark)
    ctx.from_rows(Model("customers", spark.createDataFrame([], "Id string, Name string").schema), [("c1", "Robin")])
    ctx.from_rows(Model("orders", spark.createDataFrame([], "Id string, CustomerId string").schema, references={"CustomerId": "customers"}), [("o1", "c1"), ("o2", None)])
    q = ctx.query("orders", {"Id": "o1"}).include("CustomerId")
    assert [r._included_CustomerId[0].Name for r in q.rows().collect()] == ["Robin"]
    assert rows_of(q.roots()) == [("o1", "c1")] and rows_of(q.included("CustomerId")) == [("c1", "Robin")]
    with pytest.raises(ValueError):
        ctx.query("nothing")
    with pytest.raises(ValueError):
        ctx.query("customers").include("Name")


def test_precedence_and_last_wins(spark):
    schema = "Id string, Name string, __seq int"
    none = spark.createDataFrame([], schema)
    base = spark.createDataFrame([("1", "Alice"), ("2", "Bob")], "Id string, Name string")
    adds = spark.createDataFrame([("3", "First", 1), ("3", "Charlie", 2), ("2", "Bob99", 3), ("1", "x", 4)], schema)
    ups = spark.createDataFrame([("2", "lost", 5), ("1", "lost", 6)], schema)
    c = ch.resolve(spark.createDataFrame([("1",)], "Id string"), adds, ups, "Id")
    assert rows_of(ch.apply(base, c, "Id")) == [("2", "Bob99"), ("3", "Charlie")]
    with pytest.raises(ch.DuplicateIdError):
        ch.apply(base, ch.resolve(base.filter("false").select("Id"), adds, none, "Id"), "Id", strict_insert=True)


def test_conflicts_are_exact(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "Id string, Name string, Version long")
    ups = spark.createDataFrame([("a", "n", 1), ("b", "n", 1), ("c", "n", 1)], "Id string, Name string, Version long")
    assert rows_of(ch.conflicts(base, ups, "Id", "Version").select("Id")) == [("b",), ("c",)]


def test_diff_types(spark):
    ddl = "Id int, Name string, Scores array<int>, Tags map<string,string>, N struct<a: int, m: map<string,int>>, D double"
    nan = float("nan")
    base = spark.createDataFrame([(1, "a", [1], {"x": "1", "y": "2"}, (1, {"k": 1}), nan), (2, "a", None, None, None, 1.0), (3, "a", [1, 2], {"x": "1"}, (1, None), 1.0), (4, None, [], {}, (None, {}), 0.0)], ddl)
    now = spark.createDataFrame([(1, "a", [1], {"y": "2", "x": "1"}, (1, {"k": 1}), nan), (2, "a", [], {}, None, 1.0), (3, "a", [2, 1], {"x": "2"}, (1, {"k": 1}), 1.0), (4, "b", None, None, None, 0.0)], ddl)
    got = {r.Id: r.changed for r in diff.changed_fields(base, now, "Id", base.columns[1:]).collect()}
    assert got == {3: ["Scores", "Tags", "N"], 4: ["Name", "N"]}
    assert [r.Id for r in diff.dirty(base, now, "Id", ["Name"]).collect()] == [4]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def open_(store, conventions=Conventions(), **more):
    return Session(store, [Model("people", PERSON, conventions=conventions)], conventions, **more)


def test_session_saves_and_conflicts(store):
    s = open_(store)
    s.store_one("people", {"Id": "p1", "Name": "Ann", "Version": 1})
    made = s.store_one("people", {"Name": "Bo", "Version": 1})
    assert made["Id"].startswith("people/") and len(made["Id"]) == 43
    assert s.save() == 1
    a, b = open_(store), open_(store)
    pa, pb = a.load("people", "p1"), b.load("people", "p1")
    assert a.load("people", "p1") is pa
    pa["Name"], pb["Name"] = "A", "B"
    a.save()
    assert pa["Version"] == 2
    with pytest.raises(ch.ConcurrencyError) as e:
        b.save()
    assert e.value.failed_ids == ["p1"] and store.latest() == 2
    pa["Name"] = "A2"  # sessions go on after a save
    a.save()
    assert open_(store).load("people", "p1") == {"Id": "p1", "Name": "A2", "Version": 3}
    c = open_(store)
    c.delete_one("people", "p1")
    c.save()
    pa["Name"] = "gone"
    with pytest.raises(ch.ConcurrencyError):
        a.save()


def test_session_reads_its_writes_and_discards(store):
    s = open_(store)
    s.store_one("people", {"Id": "1", "Name": "x", "Version": 1})
    s.save()
    with open_(store) as t:
        t.store_one("people", {"Id": "2", "Name": "y", "Version": 1})
        t.delete_one("people", "1")
        assert rows_of(t.query("people").rows()) == [("2", "y", 1)]
        assert t.load("people", "1") is None and t.load("people", "2")["Name"] == "y"
        assert rows_of(open_(store).rows("people")) == [("1", "x", 1)]
        assert t.pending("people") == {"added": ["2"], "removed": ["1"], "dirty": []}
    assert rows_of(open_(store).rows("people")) == [("1", "x", 1)]
    with pytest.raises(ValueError):
        open_(store).load("people", None)
    with pytest.raises(ValueError):
        open_(store).attach("people", {"Name": "no id"})


def test_bulk_changes_attach_and_unversioned(spark, store):
    s = open_(store, PLAIN)
    s.insert("people", spark.range(100).select(F.col("id").cast("string").alias("Id"), F.lit("n").alias("Name"), F.lit(0).cast("long").alias("Version")))
    s.save()
    s.delete("people", spark.range(90).select(F.col("id").cast("string")))
    s.update("people", s.base("people").filter("Id = '95'").withColumn("Name", F.lit("u")))
    s.attach("people", {"Id": "96", "Name": "n", "Version": 0})["Name"] = "edited"
    s.save()
    assert {r.Id: r.Name for r in s.rows("people").collect()} == {str(i): {95: "u", 96: "edited"}.get(i, "n") for i in range(90, 100)}
    assert rows_of(store.read("people", 1).agg(F.count(F.lit(1)))) == [(100,)]
    first, second = store.manifest(1)["people"], store.manifest(2)["people"]
    assert first["base"] == second["base"] and len(second["changes"]) == 1  # a save writes what it changes


def test_folding_keeps_rows_and_history(spark, store):
    s = open_(store)
    s.insert("people", spark.range(200).select(F.col("id").cast("string").alias("Id"), F.lit("n").alias("Name"), F.lit(1).cast("long").alias("Version")))
    s.save()
    for i in range(3):
        s.load("people", "7")["Name"] = f"seven{i}"
        s.delete_one("people", str(20 + i))
        s.store_one("people", {"Id": str(20 + i - 1), "Name": "again", "Version": 1})
        s.save()
    before = rows_of(store.read("people"))
    assert len(before) == 199 and ("7", "seven2", 4) in before and ("20", "again", 1) in before
    assert not any(r[0] == "22" for r in before) and ("19", "again", 1) in before
    assert lay_out(store, Index("people", ("Name", "Id"))) == 5
    assert rows_of(store.read("people")) == before and store.manifest(5)["people"]["changes"] == []
    assert rows_of(store.read("people", 1).agg(F.count(F.lit(1)))) == [(200,)]
    s.open()
    s.load("people", "7")["Name"] = "after"
    s.save()
    assert open_(store).load("people", "7")["Name"] == "after"


def test_vacuum_spares_staged_and_pinned_folders(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db", history=1)
    row = lambda name: spark.createDataFrame([("1", name, 1)], PERSON)
    store.publish({"people": store.stage("people", row("a"), "Id")}, 0)
    pinned = open_(store)
    staged = store.stage("people", row("b"), "Id")
    assert store.vacuum() == 0  # young folders stay
    store.publish({"people": staged}, 1)
    assert store.vacuum() == 0 and rows_of(pinned.rows("people")) == [("1", "a", 1)] and rows_of(store.read("people")) == [("1", "b", 1)]
    assert store._commits() == [2]  # older commit files went with the history
    assert store.vacuum(older_than=-1) == 1 and rows_of(store.read("people")) == [("1", "b", 1)]


def test_all_conflicts_can_be_read(spark, store):
    s = open_(store)
    s.insert("people", spark.range(1500).select(F.col("id").cast("string").alias("Id"), F.lit("n").alias("Name"), F.lit(1).cast("long").alias("Version")))
    s.save()
    late = open_(store)
    for t in (s, late):
        t.update("people", t.base("people").withColumn("Name", F.lit("m")))
    s.save()
    with pytest.raises(ch.ConcurrencyError) as e:
        late.save()
    assert e.value.count == 1500 == e.value.rows.distinct().count() and len(e.value.failed_ids) == 1000


def test_finding_tracks_and_includes(spark, store):
    m = Metrics()
    models = [Model("people", PERSON), Model("pets", T.StructType.fromDDL("Id string, Owner string"), references={"Owner": "people"}, elements={"Keeper": "Owner"})]
    s = Session(store, models, metrics=m)
    for i in "12":
        s.store_one("people", {"Id": i, "Name": f"n{i}", "Version": 1})
        s.store_one("pets", {"Id": f"pet{i}", "Owner": i})
    s.save()
    s.open()
    pets = s.find("pets", {"Keeper": {"$ne": "2"}}, include=["Keeper"])
    assert [p["Id"] for p in pets] == ["pet1"] and s.find("pets", lambda d: d["Owner"] == "1")[0] is pets[0]
    owner = s.load("people", "1")
    assert owner["Name"] == "n1" and m.count["load_seconds"] == 0 and s.tracked("people", "2") is None
    owner["Name"] = "not tracked"
    assert s.pending("people")["dirty"] == []
    pets[0]["Owner"] = "2"
    assert s.pending("pets")["dirty"] == ["pet1"]
    s.untrack("pets", "pet1")
    assert s.pending("pets")["dirty"] == [] and s.load("pets", "pet1")["Owner"] == "1" and m.count["load_seconds"] == 1
    assert m.total["query_rows"] == 2 and m.count["query_seconds"] == 2 and m.total["save_rows"] == 4


def test_attachments_go_with_their_session(store):
    s = open_(store, Conventions(bucket="media"))
    a = s.attachments()
    a.store("p1", "a", b"one")
    a.store("p1", "a", b"two!")
    a.store("p1", "b", None)
    a.store("p1", "c", b"x")
    a.delete("p1", "c")
    assert a.get("p1", "a") == b"two!" and a.get("p1", "b") == b""
    s.store_one("people", {"Id": "p1", "Name": "x", "Version": 1})
    s.save()
    assert sorted(store.tables()) == ["media.chunks", "media.files", "people"]
    t = open_(store, Conventions(bucket="media"))
    assert rows_of(t.attachments().names("p1").select("name", "size")) == [("a", 4), ("b", 0)]
    t.attachments().delete("p1", "a")
    t.attachments().store("p1", "d", b"d")
    with pytest.raises(FileNotFoundError):
        t.attachments().get("p1", "a")
    t.abort()
    assert t.attachments().get("p1", "a") == b"two!"
    with pytest.raises(FileNotFoundError):
        t.attachments().get("p1", "d")


def test_seeded_rows_keep_their_ids(spark):
    ctx = Context(spark)
    ctx.from_rows(Model("people", PERSON), [(None, "x", 1), ("2", "y", 1)])
    made = [r.Id for r in ctx.set("people").rows.collect()]
    assert made == [r.Id for r in ctx.set("people").rows.collect()] and ctx.set("people").get(made[0])["Name"] == "x"


def test_indexes_are_discovered_and_ensured(spark):
    class Definitions:
        names = Index("people", ("Name",), unique=True)
        versions = Index("people", ("Version",), unique=True)
        other = "no index"

    known = Indexes()
    assert known.discover(Definitions) == ["people", "people_1"]
    rows = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], PERSON)
    with pytest.raises(UniqueError, match="Version"):
        known.ensure(lambda name: rows)
    known.ensure(lambda name: rows.limit(1))


def test_repeated_names_in_one_batch(spark):
    rows = [("e", "a", bytearray(b"12345"), "t", 1), ("e", "a", bytearray(b"xy"), None, 2), ("e", "b", None, "t", 1)]
    blobs = spark.createDataFrame(rows, at.BLOBS + ", seq int")
    none = blobs.filter("false")
    for some, want in ((blobs, b"xy"), (blobs.drop("seq"), b"12345")):
        files, chunks = at.stored(at.files_of(none, 2), at.chunks_of(none, 2), some, 2)
        assert files.count() == 2 and at.fetch(files, chunks, "e", "a") == want and at.fetch(files, chunks, "e", "b") == b""
        assert at.reassembled(files, chunks).filter("complete").count() == 2


def test_publishing_is_compare_and_swap(spark, store):
    one = store.stage("people", spark.createDataFrame([("1", "x", 1)], PERSON), "Id")
    assert store.publish({"people": one}, 0) == 1
    with pytest.raises(StaleSnapshotError):
        store.publish({"people": store.stage("people", spark.createDataFrame([], PERSON), "Id")}, 0)
    fs, draft = store._fs(), store._path("_commits/.draft")
    fs.create(draft, False).close()
    assert not store._claim(fs, draft, store._path("_commits/000000000001.json"))


def test_untracked_fields_single_deletes_and_metrics(store):
    m = Metrics()
    s = Session(store, [Model("people", PERSON, ignored=("Name",))], metrics=m)
    s.store_one("people", {"Id": "1", "Name": "x", "Version": 1})
    s.save()
    s.load("people", "1")["Name"] = "never seen"
    assert s.pending("people")["dirty"] == [] and s.save() == 1 and m.count["save_seconds"] == 2
    s.delete_now("people", "1")
    with pytest.raises(KeyError):
        s.delete_now("people", "1")
    assert store.latest() == 2


def test_best_effort_publishes_each_collection(spark, store):
    loose = Conventions(atomic=False)
    s = Session(store, [Model(n, PERSON, conventions=loose) for n in ("a", "b")], loose, [Index("b", ("Name",), unique=True)])
    s.store_one("a", {"Id": "1", "Name": "x", "Version": 1})
    for i in "12":
        s.store_one("b", {"Id": i, "Name": "x", "Version": 1})
    with pytest.raises(UniqueError):
        s.save()
    assert store.tables() == ["a"] and rows_of(store.read("a")) == [("1", "x", 1)]


def test_unique_index_blocks_save(spark, store):
    s = open_(store, indexes=[Index("people", ("Name",), unique=True)])
    s.store_one("people", {"Id": "1", "Name": "x", "Version": 1})
    s.store_one("people", {"Id": "2", "Name": "x", "Version": 1})
    with pytest.raises(UniqueError):
        s.save()
    assert store.latest() == 0
    known = Indexes()
    assert known.add(Index("people", ("Name",))) == "people" and known.add(Index("people", ("Id",))) == "people_1"
    with pytest.raises(ValueError):
        known.add(Index("people", ("Id",), name="people"))


def test_model_ids_and_renamed_version():
    field = lambda n, t, **m: T.StructField(n, t, True, m)
    both = T.StructType([field("Id", T.StringType()), field("CustomId", T.StringType(), id=True), field("v", T.LongType())])
    m = Model("x", both, elements={"Version": "v"})
    assert m.id == "CustomId" and m.version == "v" and m.tracked == ["Id"]
    with pytest.raises(ValueError):
        Model("x", T.StructType([field("a", T.StringType())])).id


@pytest.mark.parametrize("size", [0, 1, 255 * 1024, 255 * 1024 + 1, 2 * 255 * 1024, 5 << 20])
def test_attachment_sizes(spark, size):
    data = bytes(bytearray((i * 31 + 7) % 256 for i in range(min(size, 4096))) * (size // 4096 + 1))[:size]
    blobs = spark.createDataFrame([("e1", "a.bin", bytearray(data), None)], "entity_id string, name string, data binary, content_type string")
    files, chunks = at.files_of(blobs), at.chunks_of(blobs)
    assert chunks.count() == -(-size // at.CHUNK)
    assert at.fetch(files, chunks, "e1", "a.bin") == data
    assert rows_of(at.names_of(files, "e1")) == [("a.bin", at.DEFAULT_TYPE, size)]


def test_attachment_replace_delete_corrupt(spark):
    ddl = "entity_id string, name string, data binary, content_type string"
    blobs = spark.createDataFrame([("e", "a", bytearray(b"12345"), "t"), ("e", "b", bytearray(b"xyz"), None)], ddl)
    files, chunks = at.files_of(blobs, 2), at.chunks_of(blobs, 2)
    files, chunks = at.stored(files, chunks, spark.createDataFrame([("e", "a", bytearray(b"new"), "t")], ddl), 2)
    assert at.fetch(files, chunks, "e", "a") == b"new" and files.count() == 2
    with pytest.raises(at.CorruptAttachment):
        at.fetch(files, chunks.filter("n = 0"), "e", "a")
    files, chunks = at.deleted(files, chunks, spark.createDataFrame([("e/a",)], "filename string"))
    with pytest.raises(FileNotFoundError):
        at.fetch(files, chunks, "e", "a")
    assert at.fetch(files, chunks, "e", "b") == b"xyz"


def test_metrics(spark):
    m = Metrics()
    rows, seen = m.observed(spark.range(7), "r")
    with m.command("read"):
        rows.collect()
    with pytest.raises(ZeroDivisionError), m.command("bad"):
        1 / 0
    assert seen.get["rows"] == 7 and m.count["read_seconds"] == 1 and m.total["bad_errors"] == 1


def test_stream_takes_the_same_predicates(spark, tmp_path):
    from fieldstone.plans.filters import translate

    spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], PERSON).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PERSON).parquet(f"{tmp_path}/in")
    q = stream.filter(translate({"Version": {"$gt": 1}}, PERSON)).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("kept")) == [("2", "y", 2)]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    none = spark.sparkContext._jvm.java.util.ArrayList
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, doubles, none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_saving_attachments_shuffles_names_only(spark, tmp_path):
    data = F.concat(*[F.sha2(F.concat("entity_id", F.lit(str(i))).cast("binary"), 512) for i in range(50)]).cast("binary")
    blobs = spark.range(500).select(F.col("id").cast("string").alias("entity_id"), F.lit("a").alias("name")).withColumn("data", data).withColumn("content_type", F.lit("t"))
    blobs.write.parquet(f"{tmp_path}/blobs")  # 3 MB
    blobs, s = spark.read.parquet(f"{tmp_path}/blobs"), Session(Store(spark, f"{tmp_path}/store"), [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        before = shuffled(spark)
        for rows in (blobs, blobs.filter("entity_id < 250")):
            s.attachments().store_all(rows)
            s.save()
        assert shuffled(spark) - before < 500_000
        found = s.attachments().all().filter("complete").select(F.col("metadata.EntityId").alias("entity_id"), "data")
        assert found.join(blobs, ["entity_id", "data"]).count() == found.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
