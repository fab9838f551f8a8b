"""Toxicity by a classifier chain.

The categories are predicted one after another.  The linear model of a category reads the text's
words and their starts and, beside them, the probabilities of all earlier categories.  While
training, those probabilities are out-of-fold predictions, so that later models see them as noisy as
they will be on new text; the models used on the corpus are fitted on all rows.

Training takes a bounded sample of labelled rows (``max_train``); features are made and texts are
scored in Spark tasks, and the corpus is read once.

Defined results: null and empty texts have no words and get the probabilities of an empty text; a row whose
label of a category is null tells nothing about it and is left out of that model; a category with one label
value only gets the constant probability of it; very long texts are scored whole; repeated rows get equal
results, and of labelled rows that share an id each counts; without any labelled rows all probabilities are
0; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashed, bounded_sample, in_slices
from .linear import logistic, sigmoid

BITS = 20
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Chain:
    """Per category in chain order: word weights, weights of the earlier probabilities, bias."""

    categories: tuple[str, ...]
    words: np.ndarray  # float32[categories, 2**BITS]
    earlier: tuple[np.ndarray, ...]
    bias: tuple[float, ...]


class Starts(Hashed):
    """Word -> bucket of its first four letters, which many inflected forms share."""

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = out = zlib.crc32(("^" + word[:4]).encode("utf-8", "surrogatepass")) & self.mask
        return out


def features(text: str | None, words: Hashed, starts: Hashed) -> np.ndarray:
    """Distinct buckets of the lower-cased words and their starts, sorted."""
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    heads = np.fromiter(map(starts.__getitem__, found), np.int64, len(found))
    return np.unique(np.concatenate((ids, heads)))


def _coders() -> tuple[Hashed, Hashed]:
    return Hashed(BITS), Starts(BITS)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    coders = _coders()
    for texts in in_slices(batches):
        yield pa.array([features(t, *coders).astype(np.int32) for t in texts], pa.list_(pa.int32()))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, categories: Sequence[str], folds: int = 3) -> Chain:
    """``labels``: one column per category, in chain order; 0, 1 or NaN where it is not known."""
    n = len(rows)
    fold = np.random.default_rng(1).permutation(n) % folds
    before = np.zeros((n, 0))
    words, earlier, bias = [], [], []

    def model(some: np.ndarray, y: np.ndarray):
        return logistic([rows[i] for i in some], before[some], y[some], 1 << BITS)

    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        known = ~np.isnan(y)
        values = set(y[known].tolist())
        if len(values) < 2:
            p = float(np.clip(values.pop(), 1e-6, 1 - 1e-6)) if values else 1e-9
            words.append(np.zeros(1 << BITS, np.float32))
            earlier.append(np.zeros(c))
            bias.append(float(np.log(p / (1 - p))))
            before = np.column_stack((before, np.full(n, p)))
            continue
        held = np.zeros(n)
        for k in range(folds):
            w, e, b = model(np.flatnonzero(known & (fold != k)), y)
            for i in np.flatnonzero(fold == k):
                held[i] = sigmoid(w[rows[i]].sum() + e @ before[i] + b)
        w, e, b = model(np.flatnonzero(known), y)
        words.append(w.astype(np.float32))
        earlier.append(e)
        bias.append(float(b))
        before = np.column_stack((before, held))
    return Chain(tuple(categories), np.array(words, np.float32), tuple(earlier), tuple(bias))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", max_train: int = 8000) -> Chain:
    """``categories``: for each category, in chain order, a boolean or 0/1 column over ``label.<column>``, the columns
    of ``labels``, and ``text``.  At most about ``max_train`` labelled rows are drawn, by a hash of their id."""
    named = [c for c in labels.columns if c.lower() != doc_id.lower()]
    drawn = bounded_sample(labels.filter(F.col(doc_id).isNotNull()), doc_id, max_train)
    drawn = F.broadcast(drawn.select(F.col(doc_id).alias("__id"), F.struct(*named).alias("label")))  # bounded by max_train
    both = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(drawn, "__id")
    told = [c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    got = both.select("__id", _features("text").alias("f"), *told).toPandas()
    rows = [np.asarray(f, np.int32) for f in got.pop("f")]
    order = sorted(range(len(rows)), key=lambda i: (got["__id"][i], rows[i].tobytes()))
    known = got[[f"y{i}" for i in range(len(categories))]].to_numpy(float)[order]
    return fit_chain([rows[i] for i in order], known, tuple(categories))


def probabilities(text: Column, chain: Chain, spark) -> Column:
    """struct with one probability per category."""
    shared = spark.sparkContext.broadcast((chain.words, chain.earlier, chain.bias))  # a few MB, whatever the corpus

    names = list(chain.categories)

    @F.arrow_udf(", ".join(f"`{c}` double" for c in names))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders, (words, earlier, bias) = _coders(), shared.value
        for texts in in_slices(batches):
            sums = np.array([words[:, features(t, *coders)].sum(axis=1, dtype=np.float64) for t in texts]).reshape(-1, len(bias))
            done = np.zeros((len(sums), 0))
            for c in range(len(bias)):
                done = np.column_stack((done, sigmoid(sums[:, c] + done @ earlier[c] + bias[c])))
            yield pa.StructArray.from_arrays([pa.array(x) for x in done.T], names)

    return predict(text)
