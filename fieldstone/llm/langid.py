"""Language identification by a byte convolutional network.

Texts are lower-cased, UTF-8 encoded and cut into fixed-length byte windows.  Filters of widths
2, 3 and 4 slide over each window's byte embeddings, each filter keeps its maximum, and a softmax
layer gives the window's language probabilities; a text's probabilities are the mean over all of
its windows, weighted by bytes.  The score is the best language's probability times the share of the text's
bytes that training saw, so that text of other scripts scores low.  The network is trained in numpy on a
bounded sample of labelled text; every window of every text is scored in batches inside Spark tasks.

Defined results: a null text, an empty text and a text without any letter get language ``und``
and score 0; of equally probable languages the first by name is taken; very long texts are scored whole, a
bounded number of windows at a time; repeated rows get equal results; a table without labelled rows
yields ``und`` everywhere; other columns, whatever their names, are kept and play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fresh, in_slices

WINDOW = 128
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class ByteCnn:
    """Languages, byte -> symbol map, and the per-symbol filter responses at each filter offset."""

    langs: tuple[str, ...]
    symbol: np.ndarray  # uint8[256]
    embed: np.ndarray  # float32[symbols, d]
    filters: tuple[np.ndarray, ...]  # per width: float32[width, d, n]
    bias: np.ndarray  # float32[len(WIDTHS) * n]
    dense: np.ndarray  # float32[len(WIDTHS) * n, langs]
    offset: np.ndarray  # float32[langs]


def windows_of(text: str, size: int = WINDOW) -> bytes:
    """The text's bytes, zero-padded to whole windows."""
    raw = text.lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ")
    return raw.ljust(-(-len(raw) // size) * size, b"\0")


def fit(texts: list[str], labels: list[str], dim: int = 8, n_filters: int = 16, epochs: int = 6, seed: int = 3) -> ByteCnn:
    """Trains the network by Adam on one text per window-sized snippet."""
    langs = tuple(sorted(set(labels)))
    y = np.array([langs.index(x) for x in labels], dtype=np.int64)
    raw = np.frombuffer(b"".join(windows_of(t)[:WINDOW] for t in texts), np.uint8).reshape(-1, WINDOW)
    seen = np.flatnonzero(np.bincount(raw.ravel(), minlength=256) >= 3)
    seen = seen[seen > 0][:126]
    symbol = np.ones(256, np.uint8)  # 0: padding, 1: a byte hardly seen in training
    symbol[0] = 0
    symbol[seen] = np.arange(2, 2 + len(seen))
    x = symbol[raw]
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (2 + len(seen), dim))}
    p |= {w: rng.normal(0, 0.3, (w * dim, n_filters)) for w in WIDTHS}
    p |= {"b": np.zeros(len(WIDTHS) * n_filters), "d": rng.normal(0, 0.3, (len(WIDTHS) * n_filters, len(langs))), "o": np.zeros(len(langs))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 48):
            pick = order[at : at + 48]
            grads = _gradients(p, x[pick], y[pick], dim, n_filters)
            step += 1
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-6)
    return ByteCnn(langs, symbol, p["e"], tuple(p[w].reshape(w, dim, n_filters) for w in WIDTHS), p["b"], p["d"], p["o"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, dim: int, n: int) -> dict:
    """Gradients of the mean cross-entropy; only each filter's winning position passes one back."""
    emb, rows = p["e"][x], np.arange(len(x))
    pooled, won = [], []
    for w in WIDTHS:
        flat = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * dim)
        conv = flat @ p[w]
        best = conv.argmax(axis=1)
        won.append(best)
        pooled.append(np.take_along_axis(conv, best[:, None, :], 1)[:, 0, :])
    pre = np.concatenate(pooled, 1) + p["b"]
    act = np.maximum(pre, 0)
    z = act @ p["d"] + p["o"]
    prob = np.exp(z - z.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    prob[rows, y] -= 1
    prob /= len(x)
    g = {"d": act.T @ prob, "o": prob.sum(0), "e": np.zeros_like(p["e"])}
    back = (prob @ p["d"].T) * (pre > 0)
    g["b"] = back.sum(0)
    for k, w in enumerate(WIDTHS):
        own = back[:, k * n : (k + 1) * n]
        at = won[k][:, :, None] + np.arange(w)
        sym = x[rows[:, None, None], at]  # rows, filters, offsets
        patch = p["e"][sym].reshape(len(x), n, w * dim)
        g[w] = np.einsum("rf,rfp->pf", own, patch)
        to = np.einsum("rf,pf->rfp", own, p[w]).reshape(len(x), n, w, dim)
        np.add.at(g["e"], sym.ravel(), to.reshape(-1, dim))
    return g


def scorer(model: ByteCnn):
    """A function from a list of texts to (best language number or -1, probability) arrays.

    Symbols are few, so every filter's response to each pair of adjacent symbols is tabulated once
    and the convolution becomes additions of table rows."""
    k = np.int64(len(model.embed))
    tables = []
    for w, f in zip(WIDTHS, model.filters):
        one = [model.embed @ f[j] for j in range(w)]
        two = [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(-1, f.shape[2]) for j in range(0, w - 1, 2)]
        tables.append((w, two, one[-1] if w % 2 else None))
    letter = re.compile(r"[^\W\d_]")

    def of_windows(raw: np.ndarray) -> np.ndarray:
        x = model.symbol[raw].astype(np.int64)
        pair = x[:, :-1] * k + x[:, 1:]
        pooled = []
        for w, two, last in tables:
            span = x.shape[1] - w + 1
            conv = two[0][pair[:, :span]]
            for j in range(1, len(two)):
                conv += two[j][pair[:, 2 * j : 2 * j + span]]
            if last is not None:
                conv += last[x[:, w - 1 : w - 1 + span]]
            pooled.append(conv.max(axis=1))
        z = np.maximum(np.concatenate(pooled, 1) + model.bias, 0) @ model.dense + model.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def of_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and letter.search(t)]
        if not use or not model.langs:
            return best, score
        total, weight, seen = np.zeros((len(use), len(model.langs))), np.zeros(len(use)), np.zeros(len(use))
        owners, parts, held = [], [], 0

        def flush() -> None:
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
            own = np.repeat([o for o, _ in owners], [n for _, n in owners])
            for at in range(0, len(raw), 512):
                some, mine = raw[at : at + 512], own[at : at + 512]
                size = np.count_nonzero(some, axis=1)
                np.add.at(total, mine, of_windows(some) * size[:, None])
                np.add.at(weight, mine, size)
                np.add.at(seen, mine, np.count_nonzero(model.symbol[some] > 1, axis=1))

        for j, i in enumerate(use):
            parts.append(windows_of(texts[i]))
            owners.append((j, len(parts[-1]) // WINDOW))
            held += owners[-1][1]
            if held >= 8192:
                flush()
                owners, parts, held = [], [], 0
        if parts:
            flush()
        mean = total / weight[:, None]
        best[use], score[use] = mean.argmax(1), np.minimum(mean.max(1), 1.0) * (seen / weight)
        return best, score

    return of_texts


def predictor(model: ByteCnn):
    """Column function: text -> struct(lang, score)."""

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_texts = scorer(model)
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for texts in in_slices(batches, 400):
            best, score = of_texts(texts)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang", "score"])

    return predict


def train(docs: DataFrame, text: str | Column = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_lang: int = 500, snippets: int = 4, max_langs: int = 200) -> ByteCnn:
    """Fits the network on at most about ``max_docs_per_lang`` rows of each of the ``max_langs`` most frequent
    languages, drawn by a hash of their key, and ``snippets`` window-sized snippets spread evenly over each such text."""
    body = F.col(text) if isinstance(text, str) else text
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), body.alias("text")).filter("lang IS NOT NULL AND key IS NOT NULL AND length(text) > 0")
    rows, body = bounded_sample(labelled, "key", max_docs_per_lang, "lang", max_langs), F.col("text")
    start = [F.floor(F.greatest(F.length(body) - WINDOW, F.lit(0)) * j / max(1, snippets - 1)).cast("int") + 1 for j in range(snippets)]
    got = rows.select("lang", F.array_distinct(F.array(*[F.substring(body, s, F.lit(WINDOW)) for s in start])).alias("snips")).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    texts, labels = [t for r in got for t in r[1]], [r[0] for r in got for _ in r[1]]
    if not texts:
        z = np.zeros((0, 0), np.float32)
        return ByteCnn((), np.zeros(256, np.uint8), np.zeros((1, 8), np.float32), tuple(np.zeros((w, 8, 16), np.float32) for w in WIDTHS), np.zeros(48, np.float32), z, z[0:0])
    return fit(texts, labels)


def identify(docs: DataFrame, model: ByteCnn, text: str = "text", out: str | None = None) -> DataFrame:
    """``docs`` with one more struct column (lang, score) of that name."""
    return docs.withColumn(out or fresh(docs, "lang_pred"), predictor(model)(F.col(text)))


def keep_identified(docs: DataFrame, model: ByteCnn, least: float = 0.1) -> DataFrame:
    """The rows whose text has a language that the network tells: its score is above that of a guess among the
    learned languages by at least ``least`` of what is left to 1.  The columns are those of ``docs``."""
    name, guess = fresh(docs, "lang_pred"), 1 / len(model.langs) if len(model.langs) > 1 else 0.0
    kept = identify(docs, model, out=name).filter((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= guess + least * (1 - guess)))
    return kept.drop(name)
