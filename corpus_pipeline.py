"""From raw documents to training pieces, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents.  ``run`` writes every stage's result to the shared folder as
Parquet, reads it again for the next, and removes it when that is written.

Defined results, of every stage: an empty table gives an empty one; very long texts are treated whole; other columns,
whatever their names, are kept by all stages but the last, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstone.llm import decontam, langid, overlap, pieces, pii, simhash
from fieldstone.llm.common import discard, id_remainder, settle, table
from fieldstone.llm.queries import model_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language the network can't tell.
    Repeated rows are judged alike; a row without an id or language is judged, but not learned from."""
    return langid.keep_identified(docs, langid.train(docs.filter(id_remainder(3) != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every component of near copies: fingerprints within the radius, or five-word shingles of a
    Jaccard similarity of 0.8 or more.  It is the one with the smallest id; of rows that share it, or of components
    without ids, the one with the smallest text hash.  Texts without words are copies of one another."""
    return simhash.keep_one(docs, more=overlap.joined)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, reordered or not.  Each row is judged by its own text, also where
    rows share an id or have none; null and empty texts stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms, equal values by equal ones, and renews ``n_chars``.  All rows stay; null and
    empty texts stay as they are."""
    return pii.mask_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, checked to decode to its text.  All rows stay; a null text has null pieces, an empty
    one none."""
    return pieces.encode_documents(docs, pieces.Vocabulary.load(model_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

# Trained networks, fingerprints and segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
