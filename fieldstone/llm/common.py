"""Shared pieces: reading tables, settled intermediate tables, hashed word features."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod ``n``; rows without an id count as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


SLICE = 256


def in_slices(batches: Iterator, rows: int = SLICE) -> Iterator:
    """The values of Arrow arrays (or tuples of them) as lists of at most ``rows``.  A batch may hold many
    MB of texts, of which a task turns only a part at a time into Python objects."""
    for batch in batches:
        many = isinstance(batch, tuple)
        for at in range(0, len(batch[0] if many else batch), rows):
            yield tuple(a.slice(at, rows).to_pylist() for a in batch) if many else batch.slice(at, rows).to_pylist()


def once(udf):
    """The function, for results that rows are then filtered by.  The planner would put such a filter below them, and run the
    function for it and again for its result, in twice as many Python workers; one it takes for non-deterministic it leaves in place."""
    return udf.asNondeterministic()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is configured a temporary one is set for local
    masters, and others are refused: executors would not see one another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fieldstone-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def _place(spark: SparkSession, path: str):
    """The path and its file system."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it back: cuts the lineage, survives lost
    executors, and gives the planner the true size, so that it broadcasts only what is small.  The table
    goes with ``discard``, or else, also after a failure, when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldstone-{name}-{uuid.uuid4().hex}"
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes settled tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path:
            at, fs = _place(df.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def bounded_sample(rows: DataFrame, key: str, most: int, strata: str | None = None, max_strata: int = 1000) -> DataFrame:
    """At most about ``most`` rows (per stratum), chosen by a hash of ``key``: the same rows on
    every run, without sorting or collecting the table; of more than twice as many, which only rows of
    one key can bring about, any.  Of more than ``max_strata`` strata the largest are sampled, of
    equally large ones the first by value."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20))
    if strata is None:
        n = rows.count()
        return rows.filter(draw < _rate(n, most)).limit(2 * most)
    of = F.col(strata)
    counts = rows.groupBy(of.alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.orderBy(F.desc("__n"), F.asc_nulls_first("__of")).limit(max_strata)
    rate = F.when(F.col("__n") <= most, F.lit(1 << 20)).otherwise(F.greatest(F.lit(1), F.expr(f"({most} * {1 << 20}L) div __n")))
    drawn = rows.join(F.broadcast(counts), of.eqNullSafe(F.col("__of"))).filter(draw < rate)  # max_strata rows
    return drawn.drop("__of", "__n").limit(2 * most * max_strata)


def _rate(n: int, most: int) -> int:
    return (1 << 20) if n <= most else max(1, (most << 20) // n)


class Hashed(dict):
    """Word -> bucket below ``2**bits``, remembered; forgets all when it holds too many words."""

    def __init__(self, bits: int, most: int = 150_000):
        super().__init__()
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return out


def pairs_of(ids: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of adjacent pairs of buckets."""
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)
