"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of n-grams: words, adjacent word pairs, and runs of one to three word
shapes (case, digits, punctuation, and whether the word repeats the one before).  Each indicator is
scaled by the log-count ratio of its class counts, and a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent.  Margins become probabilities by a sigmoid fitted on margins
of rows outside the fold that the model saw.

Training takes a bounded sample of labelled rows (``max_train``); features are made and texts are
scored in Spark tasks, and the corpus is read once.

Defined results: null and empty texts have no n-grams and get the score of the bias alone; very long
texts are scored whole; repeated rows get equal results, and of labelled rows that share an id each counts;
rows with a null label are left out; with one label value only the score is that value's smoothed share, and
0.5 without labelled rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashed, bounded_sample, in_slices, pairs_of
from .linear import hinge_dual, log_count_ratio, platt, sigmoid

BITS = 18
SAME = 1 << BITS  # the bucket of a word that repeats the one before, above all hashed ones


@dataclass(frozen=True)
class NbSvm:
    """Weight of each n-gram bucket, bias, and the sigmoid from margins to probabilities."""

    weights: np.ndarray  # float32[2**BITS + 1]
    bias: float
    slope: float
    offset: float


def shape(word: str) -> str:
    """Case, digits and punctuation of a word, each run as one or (punctuation) as it is."""
    upper = word.isupper() and len(word) > 1
    out = []
    for c in word[:40]:
        k = ("A" if upper or c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not (k in "Aa9" and out and out[-1] == k):
            out.append(k)
    return "".join(out[:12]) + ("+" if upper else "")


class Shapes(Hashed):
    """Word -> bucket of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = out = zlib.crc32(("\0" + shape(word)).encode("utf-8", "surrogatepass")) & self.mask
        return out


def features(text: str | None, words: Hashed, shapes: Hashed) -> np.ndarray:
    """Distinct buckets of the text's n-grams, sorted."""
    tokens = text.split() if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    s = np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens))
    s[1:][w[1:] == w[:-1]] = SAME
    two = pairs_of(s, 22, BITS)
    return np.unique(np.concatenate((w, pairs_of(w, 11, BITS), s, two, pairs_of(two, 33, BITS))))


def _coders() -> tuple[Hashed, Hashed]:
    return Hashed(BITS), Shapes(BITS)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    coders = _coders()
    for texts in in_slices(batches):
        yield pa.array([features(t, *coders).astype(np.int32) for t in texts], pa.list_(pa.int32()))


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 0.5, folds: int = 2) -> NbSvm:
    """Ratios, hinge-loss weights and the sigmoid."""
    n, dim = len(rows), SAME + 1
    if n == 0 or len(set(y.tolist())) < 2:
        p = 0.5 if n == 0 else (float(y.sum()) + 1) / (n + 2)
        return NbSvm(np.zeros(dim, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = np.bincount(np.concatenate(rows), minlength=dim)
    rows = [r[counts[r] >= 3] for r in rows]

    def model(some: np.ndarray):
        part = [rows[i] for i in some]
        return hinge_dual(part, log_count_ratio(part, y[some], dim), y[some], c)

    fold, margin = np.random.default_rng(2).permutation(n) % folds, np.zeros(n)
    for k in range(folds):
        w, b = model(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() + b
    w, b = model(np.arange(n))
    slope, offset = platt(margin, y)
    return NbSvm(w.astype(np.float32), float(b), slope, offset)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 5000) -> NbSvm:
    """Fits the model on at most about ``max_train`` labelled rows, drawn by a hash of their id."""
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    drawn = bounded_sample(usable, doc_id, max_train).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y"))
    both = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(drawn), "__id")  # bounded by max_train
    got = both.select("__id", "y", _features("text").alias("f")).toPandas()
    rows = [np.asarray(f, np.int64) for f in got["f"]]
    order = sorted(range(len(rows)), key=lambda i: (got["__id"][i], got["y"][i], rows[i].tobytes()))
    return fit([rows[i] for i in order], got["y"].to_numpy()[order])


def score(text: Column, model: NbSvm, spark) -> Column:
    """Probability of label 1."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))  # 1 MB, whatever the corpus

    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders, (weights, bias, slope, offset) = _coders(), shared.value
        for texts in in_slices(batches):
            margin = np.array([weights[features(t, *coders)].sum(dtype=np.float64) for t in texts]) + bias
            yield pa.array(sigmoid(slope * margin + offset))

    return predict(text)
