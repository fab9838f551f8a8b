"""Python functions of the stages run once for each row."""

import re

import corpus_pipeline
from fieldstone.llm import common, decontam, overlap


def test_no_function_runs_again_below_a_filter(spark, monkeypatch):
    plans = {}

    def settle(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.settle(df, name)

    monkeypatch.setattr(overlap, "settle", settle)
    monkeypatch.setattr(decontam, "settle", settle)
    item = "one two three four five six seven eight nine ten"
    texts = [item + " and more words", "a b c d e f g h", "a b c d e f g h i", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 3]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontam.keep_clean(docs, benchmark).collect()
    assert sorted(r.doc_id for r in clean) == [1, 2, 3, 4]
    for name in ("sets", "seeded", "leaks"):
        assert len(re.findall(r"ArrowEvalPython \[", plans[name])) == 1, plans[name]
