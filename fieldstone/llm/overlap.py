"""Near copies by exact overlap, to complete a search by fingerprints.

Two texts are near copies if their sets of word shingles (runs of five lower-cased words of letters
and digits; a text of fewer words is one shingle) have a Jaccard similarity of at least ``least``.

1. Candidates.  Of two such sets of n and m shingles each holds ``least`` of the other's, so in any one
   order of all shingles they share one among the first ``n - ceil(least * n) + 1`` of each.  Only these are
   dealt out.  Frequent shingles, counted over all texts, come last in the order, so that passages many
   texts share are dealt only where little else is in a text.  Of two near copies' common shingles the first in that order
   has enough shingles behind it, in either text, for all that they must share; other pairs are not made.  Most shingles are
   in one text only, so they are first dealt in packed rows, by ranges of hashes, and only those go on that some pair may come from.
2. Filter.  A text's parity bits (one per shingle, at least) differ from another's in no more places than the
   sets do, so pairs that differ in more than a Jaccard similarity of ``least`` allows are dropped.
3. Check.  The remaining pairs' similarity is computed from their texts.

Pairs already in one component need no link.  Of a large group of near copies even the pairs that are alike grow with the
square of its size, so up to ``TURNS`` linear turns come first, each of which tries every dealt shingle's text with
``TRIES`` others that share it, drawn anew by hash in each turn: they join nearly all that belongs together, as random
edges join a graph.  The last turn tries all pairs of texts that are still in different components.

Defined results: null and empty texts have no shingles and are not linked here; equal texts are one
text; a shingle counts once however often it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_slices, once, settle
from .decontam import WordHashes, rolling
from .simhash import connected

LEAST = 0.8
WIDTH = 5
TOGETHER = 1 << 21  # shingles of texts that are counted together
FREQUENT = 100_000  # frequent shingles told apart, at most
FLUSH = 1 << 15  # pairs that a task holds before they are written
SHARD = 1 << 18  # first shingles that are searched together for repeated ones
TURNS = 4
TRIES = 2
WORTH = 0.01  # links by pair that a linear turn must find for another one


def within(na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """In how many shingles at most sets of these sizes differ if they are as alike as ``least``."""
    return (na + nb) * (1 - least) / (1 + least) + 1e-9


def shingles(known: WordHashes, text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = known.of(text)
    return np.unique(rolling(words, max(1, min(width, len(words)))))


def first_shingles(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """Those that any set as alike as ``least`` shares one of, frequent shingles (sorted, with their ranks) last."""
    place = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        place = np.where(frequent[at] == found, rank[at], 0)
    return found[np.argsort(place, kind="stable")][: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]


def parity(found: np.ndarray) -> bytes:
    """As many bits as shingles, rounded up to a power of two of at least 64: bit b says if an odd number of hashes end in b."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Places in which two parities differ; the longer one is folded to the shorter one's length."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``FREQUENT``, sorted, and their ranks from 1, the most frequent last.  Counts are over all texts, and
    leave out what only one of some thousand texts read together holds; copies read together count once."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, texts, size = WordHashes(), [], set(), 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for k, some in ((k, t) for batch in batches for k, t in zip(in_slices([batch.column(0)]), in_slices([batch.column(1)]))):
            for key, text in zip(k, some):
                if key not in texts:
                    texts.add(key)
                    sets.append(shingles(known, text))
                    size += len(sets[-1])
            if size > TOGETHER:
                yield counted()
                sets, texts, size = [], set(), 0
        if sets:
            yield counted()

    held = texts.select("k", "text").mapInArrow(repeated, "h long, n long")
    held = settle(held.groupBy("h").agg(F.sum("n").alias("n")).withColumn("size", F.floor(8 * F.log2("n")).cast("int")), "frequent")
    least, room = None, FREQUENT
    for size, n in sorted(held.groupBy("size").count().collect(), reverse=True):  # some hundred sizes at most
        room -= n
        if room < 0:
            break
        least = size
    top = held.filter(F.col("size") >= least if least is not None else F.lit(False)).select("h", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    discard(held)
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def parity_distances(parities: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parity_distance`` of the parities at places i and j."""
    size = np.fromiter(map(len, parities), np.int64, len(parities))
    out = np.zeros(len(i), np.int64)
    i, j = np.where(size[i] < size[j], i, j), np.where(size[i] < size[j], j, i)
    for a, b in np.unique(np.stack((size[i], size[j])), axis=1).T.tolist():
        at = np.flatnonzero((size[i] == a) & (size[j] == b))
        for s in range(0, len(at), 4096):
            some = at[s : s + 4096]
            x, y = (np.frombuffer(b"".join(parities[of[some]]), np.uint64).reshape(len(some), -1) for of in (i, j))
            y = np.bitwise_xor.reduce(y.reshape(len(some), -1, a // 8), axis=1)
            out[some] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def may_pair(token: np.ndarray, n: np.ndarray, left: np.ndarray, least: float) -> np.ndarray:
    """Which of the rows, sorted by (token, n), have another of the same token with which, of the shingles from the token on
    (``left``), both have enough to share.  Row i goes with sizes up to ``up[i]``, and j is such a one for i if n[j] <= up[i] and n[i] <= up[j]."""
    if not len(token):
        return np.zeros(0, bool)
    up = np.floor((left + 1e-5) * ((1 + least) / least)).astype(np.int64) - n
    base = np.concatenate(([0], np.cumsum(np.diff(token) != 0))) * (4 * int(n.max()) + 4)
    most = np.maximum.accumulate(base + up)
    second = np.maximum.accumulate(np.minimum(base + up, np.append(-1, most[:-1])))
    upto = np.searchsorted(base + n, base + up, "right")
    best = np.where(up >= n, second[upto - 1], most[upto - 1])  # without the row itself
    return (upto > 0) & (best >= base + n)


def candidate_pairs(token: np.ndarray, k: np.ndarray, n: np.ndarray, label: np.ndarray, left: np.ndarray, least: float, every: bool, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in rows sorted by (token, n): of one token, sizes that allow ``least``, different labels, and, of the
    shingles from the token on (``left``), in both enough to share.  Without ``every`` only pairs of each row with the ``TRIES``
    next ones of about its size, in an order by a hash of text, token and ``turn``."""

    def fit(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return (label[j] != label[i]) & (np.minimum(left[j], left[i]) >= (n[j] + n[i]) * (least / (1 + least)) - 1e-6)

    if not every:
        drawn = (k.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) % (1 << 64)) ^ token.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        order = np.lexsort((drawn ^ (drawn >> np.uint64(31)), np.floor(np.log(n) / np.log(1 / least) * 2 + turn / 3), token))
        for d in range(1, TRIES + 1):
            i, j = order[:-d], order[d:]
            near = (token[i] == token[j]) & fit(i, j)
            yield i[near], j[near]
        return
    starts = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1))
    ends = np.append(starts[1:], len(token))
    mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        sizes = n[s:e]
        for i in range(s, e - 1):
            near = np.arange(i + 1, s + int(np.searchsorted(sizes * least, n[i] + 1e-9, "right")))
            near = near[fit(i, near)]
            if len(near):
                yield np.full(len(near), i), near


def _entries(sets: DataFrame, least: float) -> DataFrame:
    """From (k, n, first), copies included: (token, k, n, left) of all first shingles that some pair may come from; settled.  They
    are dealt in rows of many, of which each text's stand together, and those of equal ranges of hashes meet."""
    shards = max(1, int((sets.agg(F.sum(F.col("n") / 5 + 1)).first()[0] or 0) / SHARD))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0

        def cut() -> pa.RecordBatch:
            k, n, many, token = (np.concatenate(x) for x in zip(*waiting))
            at = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
            text = np.repeat(np.arange(len(k)), many)
            shard = ((token.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, text = shard[order], text[order]
            edge = np.flatnonzero(np.diff(shard)) + 1
            run = np.concatenate(([0], np.flatnonzero((np.diff(shard) != 0) | (np.diff(text) != 0)) + 1))
            starts = np.concatenate(([0], edge))
            of_run = np.append(np.searchsorted(run, starts), len(run)).astype(np.int32)
            of_all = np.append(starts, len(shard)).astype(np.int32)
            lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))
            most = np.minimum(at[order], np.iinfo(np.int16).max).astype(np.int16)  # a lower place than the true one only lets more pairs through
            columns = [lists(of_run, k[text[run]]), lists(of_run, n[text[run]]), lists(of_run, np.diff(np.append(run, len(shard))).astype(np.int32)), lists(of_all, token[order]), lists(of_all, most)]
            return pa.RecordBatch.from_arrays([pa.array(shard[starts]), *columns], ["shard", "k", "n", "many", "token", "at"])

        for batch in batches:
            first = batch.column(2)
            for s in range(0, len(first), 1024):
                some = first.slice(s, 1024)
                many = np.diff(some.offsets.to_numpy())
                waiting.append([*(batch.column(c).slice(s, 1024).to_numpy(zero_copy_only=False) for c in (0, 1)), many, some.flatten().to_numpy(zero_copy_only=False)])
                size += len(waiting[-1][3])
                if size > TOGETHER // 2:
                    yield cut()
                    waiting, size = [], 0
        if size:
            yield cut()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        now = None

        def found() -> pa.RecordBatch:
            k, n, token, at = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((k, n, token))
            k, n, token, at = (x[order] for x in (k, n, token, at))
            one = np.append(True, (np.diff(token) != 0) | (np.diff(k) != 0))  # copies are one text
            k, n, token, left = k[one], n[one].astype(np.int64), token[one], (n - at)[one].astype(np.int64)
            keep = may_pair(token, n, left, least)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, k, n, left)], ["token", "k", "n", "left"])

        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column(0)[r].as_py()
                if shard != now and waiting:
                    yield found()
                    waiting = []
                now = shard
                k, n, many, token, at = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
                waiting.append([np.repeat(k, many), np.repeat(n, many), token, at.astype(np.int32)])
        if waiting:
            yield found()

    dealt = sets.select("k", "n", "first").mapInArrow(packed, "shard long, k array<long>, n array<int>, many array<int>, token array<long>, at array<short>")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    return settle(dealt.mapInArrow(repeated, "token long, k long, n long, left long"), "entries")


def _paired(entries: DataFrame, least: float, every: bool, turn: int) -> DataFrame:
    """From (token, k, n, label, left): distinct candidate pairs (a, b, la, lb); if all are tried, from parities, too, and only
    pairs that the filter lets through."""
    columns = ["token", "k", "n", "label", "left"] + ["parity"] * every
    keyed = entries.repartition("token").sortWithinPartitions("token", "n", "k")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            some: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for pair in candidate_pairs(*rows[:5], least, every, turn):
                some.append(pair)
                size += len(pair[0])
                if size > FLUSH:
                    yield made(some, rows)
                    some, size = [], 0
            if some:
                yield made(some, rows)

        def made(some: list[tuple[np.ndarray, np.ndarray]], rows: list[np.ndarray]) -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*some))
            k, n, label = rows[1:4]
            if every:
                near = parity_distances(rows[5], i, j) <= within(n[i], n[j], least)
                i, j = i[near], j[near]
            i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
            rows = np.unique(np.stack((k[i], k[j], label[i], label[j])), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "la", "lb"])

        held = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, object)] * every
        waiting: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < FLUSH:
                continue
            held = [np.concatenate(x) for x in zip(held, *waiting)]
            waiting, size = [], 0
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from pairs([x[:last] for x in held])
                held = [x[last:] for x in held]
        held = [np.concatenate(x) for x in zip(held, *waiting)]
        if len(held[0]):
            yield from pairs(held)

    return keyed.select(*columns).mapInArrow(search, "a long, b long, la long, lb long").distinct()


def joined(texts: DataFrame, nodes: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """From texts (k, text), the node of each k (k, node) and the roots of nodes' components (node, root), of all but single
    ones: the roots after all near copies are joined, too.  Discards ``names``."""
    told = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    @F.arrow_udf("n int, first array<long>, parity binary")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for some in in_slices(batches):
            sets = [shingles(known, t) for t in some]
            first = [first_shingles(s, *told.value, least).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([parity(s) if len(s) else b"" for s in sets], pa.binary())]
            yield pa.StructArray.from_arrays(columns, ["n", "first", "parity"])

    @F.arrow_udf("boolean")
    def may_be(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for na, xs, nb, ys in in_slices(batches, 4096):
            yield pa.array(np.array([parity_distance(x, y) for x, y in zip(xs, ys)]) <= within(np.array(na), np.array(nb), least))

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = WordHashes()
        for some, others in in_slices(batches):
            out = []
            for t, u in zip(some, others):
                x, y = shingles(known, t), shingles(known, u)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.array(out, pa.bool_())

    sets = settle(texts.select("k", once(described)("text").alias("s")).filter("s.n > 0").select("k", "s.*"), "sets")
    entries = _entries(sets, least)
    known = settle(sets.select("k", "n", "parity").dropDuplicates(["k"]).join(nodes, "k"), "known")
    discard(sets)
    side = lambda x: known.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    turn, every = 0, False
    while True:
        carried = ["parity"] * every  # in the last turn pairs are filtered where they are made
        labels = settle(known.select("k", "node", *carried).join(names, "node", "left").select("k", F.coalesce("root", "node").alias("label"), *carried), "labels")
        pairs = settle(_paired(entries.join(labels, "k"), least, every, turn), "pairs")
        near = pairs if every else settle(pairs.join(side("a"), "a").join(side("b"), "b").filter(may_be("na", "pa", "nb", "pb")).select("a", "b", "la", "lb"), "near")
        keys = near.select(F.col("a").alias("k")).union(near.select("b")).distinct()
        held = settle(texts.join(keys, "k", "left_semi").dropDuplicates(["k"]), "held")
        whole = near.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b")
        found = settle(whole.filter(alike("ta", "tb")).select("la", "lb").distinct(), "found")
        links, tried = found.count(), pairs.count()
        if links:
            last, names = names, connected(names.union(found).toDF("a", "b"))
            discard(last)
        discard(labels, pairs, near, held, found)
        if every:
            break
        turn += 1
        every = turn == TURNS or links <= WORTH * tried
    discard(entries, known)
    return names
