"""The pipeline's stages, each against a plain version of its decision, and on awkward rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldstone.llm import simhash
from fieldstone.llm.common import settle, table

WORD = re.compile(r"[^\W_]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b, prints, sets):
    alike = bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    return alike or (prints[a] ^ prints[b]).bit_count() <= 3


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == columns
        gone = set(before) - set(after)
        assert set(after) <= set(before)
        if name == "language":
            assert all(re.search(r"[^\W\d_]", r.text) for r in after.values()) and len(gone) <= 0.02 * len(before)
        elif name == "near_duplicates":
            prints, sets = {k: simhash.simhash(r.text) for k, r in before.items()}, {k: shingles(r.text) for k, r in before.items()}
            assert gone and all(any(near(k, o, prints, sets) for o in before if o != k) for k in gone)
            kept = sorted(after)
            assert not any(near(a, b, prints, sets) for i, a in enumerate(kept) for b in kept[i + 1 :])
        elif name == "decontamination":
            words = lambda t: WORD.findall(t.lower())
            items = [words(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            whole = {k for k, r in before.items() if any(f" {' '.join(i)} " in f" {' '.join(words(r.text))} " for i in items)}
            assert whole and whole <= gone
            for k in gone:  # no document is dropped that shares less than four fifths of every item's words
                own = set(words(before[k].text))
                assert any(sum(w in own for w in i) >= 0.8 * len(i) for i in items)
        elif name == "personal_data":
            assert not gone and all(len(r.text) == r.n_chars for r in after.values())
            assert not any(re.search(r"@mail\d+\.example", r.text) for r in after.values())
            clean = [k for k, r in before.items() if not re.search(r"\d|@|=", r.text)]
            assert clean and all(after[k].text == before[k].text for k in clean)
        else:
            assert not gone and all(r.round_trip for r in after.values())
        before = after


def test_reordered_leaks_go_and_quotations_stay(spark, sf_dir):
    item = next(r.text for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect() if len(r.text.split()) > 25)
    w = item.split()
    third = len(w) // 3
    reordered = " ".join(w[2 * third :] + ["and", "then"] + w[:third] + ["or", "else"] + w[third : 2 * third])
    rows = [(1, item), (2, f"before {reordered} after"), (3, " ".join(w[: len(w) // 2])), (4, "nothing of it"), (None, item), (None, "clean without an id"), (4, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((d or -1, t) for d, t in rows if t in (rows[2][1], rows[3][1], rows[5][1]))


AWKWARD = [(1, None), (2, ""), (3, "## 12 --"), (4, "plain words of an ordinary kind here"), (4, "plain words of an ordinary kind here"), (5, "plain words of an ordinary kind here"), (None, "plain words of an ordinary kind here"), (None, "other words, written down without any number"), (6, "mail to bo@mail8.example.com about it, and thanks for the help"), (7, " ".join(f"w{i % 977} of the" for i in range(30_000)))]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf_dir, name):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    docs = docs.unionByName(table(spark, sf_dir, "documents").filter("doc_id between 20 and 60").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    for c in ("__lang_pred", "__key", "__k", "__n", "__one", "__two", "__masked", "root", "key", "doc", "hits"):
        docs = docs.withColumn(c, F.lit("clash"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    if name != "tokens":
        assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    ids = sorted(i if i is not None else -1 for i in ids if i is None or i < 20)
    want = {
        "language": [-1, -1, 4, 4, 5, 6, 7],
        "near_duplicates": [-1, 1, 3, 4, 6, 7],
        "decontamination": [-1, -1, 1, 2, 3, 4, 4, 5, 6, 7],
        "personal_data": [-1, -1, 1, 2, 3, 4, 4, 5, 6, 7],
        "tokens": [-1, -1, 1, 2, 3, 4, 4, 5, 6, 7],
    }
    assert ids == want[name]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
