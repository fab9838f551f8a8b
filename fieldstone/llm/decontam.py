"""Benchmark decontamination by greedy string tiling.

1. Seeds.  Every run of ``min_match`` words of the benchmark is hashed (Karp-Rabin); an item of fewer words is one
   run.  A bit filter of bounded size over the seed hashes is broadcast; documents are read once and each
   keeps its distinct hashes that pass the filter.  Only documents with enough such hashes for some item go on.
2. Candidates.  A tiling that covers a share ``threshold`` of an item's n words by tiles of at least
   ``min_match`` words contains at least threshold * n / min_match of the item's seeds.  Of each item the seeds that
   most documents have are left out, as far as half of that number, and pairs that share fewer of the
   others than then must be left are dropped, without loss.  Seeds are joined in ``SALT`` parts of the documents.
3. Tiling.  For each pair the longest non-overlapping matches are marked again and again: running
   Karp-Rabin hashes of the current length find them, they are extended to their ends, the longest
   are marked as tiles, what is left of the others goes on, and the length falls until ``min_match``.  Marked
   words can't match again, so passages whose sentences were reordered are still covered in full.

An item leaks into a document if the tiles cover at least ``threshold`` of the item's words.

Defined results: null and empty texts have no words and never match; an item of fewer than ``min_match`` words
leaks where all its words stand in order; of equally long matches the first in the item, then in the document, is
marked; repeated documents and items are judged each on its own; an empty benchmark leaks nowhere; very long texts
are hashed whole; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, in_slices, once, settle

MIN_MATCH = 5
THRESHOLD = 0.8
BASE = 0x9E3779B97F4A7C15
SALT = 16
FILTER_BITS = (16, 26)  # log2 of the filter's size, least and most: 8 kB to 8 MB


BYTE_BASE = 0x100000001B3
IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
SEPARATOR = re.compile(r"[^\x00-\x7f\w]+")


class WordHashes:
    """Hashes of a text's lower-cased words of letters and digits, in order, all at once: each is the
    difference of two prefix sums of bytes times powers, brought to the power 0, and mixed."""

    def __init__(self):
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        ones = np.full(n, BYTE_BASE, np.uint64)
        ones[0] = 1
        self.power = np.multiply.accumulate(ones)
        ones[1:] = pow(BYTE_BASE, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(ones)

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        text = text.lower()
        if not text.isascii() and SEPARATOR.search(text):
            text = SEPARATOR.sub(" ", text)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) > len(self.power):
            self._powers(2 * len(raw))
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = IN_WORD[raw]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of BASE and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            ones = np.full(2 * n, base, np.uint64)
            ones[0] = 1
            _POWERS[k] = np.multiply.accumulate(ones)
    return _POWERS


class Runs:
    """Karp-Rabin hashes of runs of words of any length, each the difference of two prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.words = hashes
        power, self.inverse = _powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self.sums[1:])

    def at(self, start: np.ndarray, n) -> np.ndarray:
        """The hashes of the runs of ``n`` words from each start."""
        return (self.sums[start + n] - self.sums[start]) * self.inverse[start]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of ``n`` words."""
    return Runs(hashes).at(np.arange(max(0, len(hashes) - n + 1)), n)


PAIRS = 1 << 20  # pairs of places looked at together


def _free_from(free: np.ndarray) -> np.ndarray:
    """How many words are free from each place on."""
    taken = np.append(np.flatnonzero(~free), len(free))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def _matches(item: Runs, doc: Runs, free_i: np.ndarray, free_d: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(lengths, starts in item, starts in doc) of all matches of free words, as long as they go, of at least ``size`` words."""
    left_i, left_d = _free_from(free_i), _free_from(free_d)
    at_i, at_d = np.flatnonzero(left_i >= size), np.flatnonzero(left_d >= size)
    if not len(at_i) or not len(at_d):
        return
    hash_i, hash_d = item.at(at_i, size), doc.at(at_d, size)
    order = np.argsort(hash_i, kind="stable")
    hash_i, at_i = hash_i[order], at_i[order]
    low = np.searchsorted(hash_i, hash_d, "left")
    many = np.searchsorted(hash_i, hash_d, "right") - low
    at_d, low, many = at_d[many > 0], low[many > 0], many[many > 0]
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS), "left") + 1 if len(many) else []
    done = 0
    for end in np.unique(np.minimum(cuts, len(many))).tolist() if len(many) else []:
        n = many[done:end]
        d = np.repeat(at_d[done:end], n)
        i = at_i[np.repeat(low[done:end] - np.cumsum(n) + n, n) + np.arange(len(d))]
        done = end
        first = (i == 0) | (d == 0)
        before_i, before_d = np.maximum(i - 1, 0), np.maximum(d - 1, 0)
        first |= (item.words[before_i] != doc.words[before_d]) | ~free_i[before_i] | ~free_d[before_d]
        i, d = i[first], d[first]  # the others are parts of a match that starts earlier
        short, long = np.full(len(i), size), np.minimum(left_i[i], left_d[d])
        while (short < long).any():
            middle = (short + long + 1) // 2
            same = item.at(i, middle) == doc.at(d, middle)
            short, long = np.where(same, middle, short), np.where(same, long, middle - 1)
        yield short, i, d


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles."""
    tiles: list[tuple[int, int, int]] = []
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    runs_i, runs_d = Runs(item), Runs(doc)
    least = max(1, min(min_match, len(item)))
    size = len(item)
    while size >= least:
        todo = [(-n, i, d) for found in _matches(runs_i, runs_d, free_i, free_d, size) for n, i, d in zip(*(x.tolist() for x in found))]
        heapq.heapify(todo)
        while todo:
            n, i, d = heapq.heappop(todo)
            both = free_i[i : i - n] & free_d[d : d - n]
            if both.all():
                free_i[i : i - n] = free_d[d : d - n] = False
                tiles.append((i, d, -n))
            elif both.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], both.view(np.int8), [0]))))
                for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if end - start >= size:
                        heapq.heappush(todo, (start - end, i + start, d + start))
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def benchmark_seeds(benchmark: DataFrame, item_id: str, text: str, min_match: int) -> DataFrame:
    """(item_row, item_id, item, words, width, seeds): each item's word count, the words of a seed, its seed hashes in order."""

    @F.arrow_udf("words int, seeds array<long>")
    def seeds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for texts in in_slices(batches):
            rows = [known.of(t) for t in texts]
            made = [seeds_of(r, min(min_match, len(r))).view(np.int64) if len(r) else np.zeros(0, np.int64) for r in rows]
            yield pa.StructArray.from_arrays([pa.array([len(r) for r in rows], pa.int32()), pa.array(made, pa.list_(pa.int64()))], ["words", "seeds"])

    of = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("item"), F.monotonically_increasing_id().alias("item_row"))
    width = F.least(F.lit(min_match), F.col("s.words")).alias("width")
    return of.withColumn("s", seeds("item")).select("item_id", "item", "item_row", F.col("s.words").alias("words"), width, F.col("s.seeds").alias("seeds"))


def seeds_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, apart from those of other widths."""
    return (rolling(hashes, width) ^ np.uint64(width)) * np.uint64(0xD6E8FEB86659FD93)


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A bit array of 2**16 to 2**26 bits with the bit of every seed set.  Its size is fixed, so it
    may be broadcast whatever the benchmark's size; a fuller filter only lets more through."""
    bits = int(min(max(np.ceil(np.log2(4096 * max(count, 1))), FILTER_BITS[0]), FILTER_BITS[1]))
    place = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def probes(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """From the items' seeds (item_row, seed, n, need) and the documents' (doc_row, seed): the seeds to join (item_row,
    seed, n, least), where ``least`` of the item's must be found.  The most frequent seeds are left out, as far
    as half of ``need``."""
    spread = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    told = seeds.join(spread, "seed").withColumn("above", F.sum("n").over(Window.partitionBy("item_row").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)))
    dropped = F.col("above") <= F.floor(F.col("need") / 2)
    out = F.coalesce(F.sum(F.when(dropped, F.col("n"))).over(Window.partitionBy("item_row")), F.lit(0))
    return told.withColumn("least", F.col("need") - out).filter(~dropped).select("item_row", "seed", "n", "least")


def _leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, min_match: int, threshold: float) -> DataFrame:
    """``leaks`` with two hashes of the text; settled."""
    spark = docs.sparkSession
    items = settle(benchmark_seeds(benchmark, item_id, item_text, min_match), "items")
    need = F.ceil(F.round(F.col("words") * threshold / F.col("width"), 9))
    seeds = items.select("item_row", "words", "width", F.explode("seeds").alias("seed")).groupBy("item_row", "seed").agg(F.count(F.lit(1)).alias("n"), F.first(need).alias("need"))
    seeds = settle(seeds, "seeds")
    count, least = seeds.agg(F.count(F.lit(1)), F.min(F.ceil(F.col("need") / F.col("n")))).first()
    widths = sorted(r[0] for r in items.filter("words > 0").select("width").distinct().collect())  # at most min_match
    field = spark.sparkContext.broadcast(seed_filter(seeds, count))

    @F.arrow_udf("array<long>")
    def passing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, bits = WordHashes(), field.value
        shift = np.uint64(64 - int(np.log2(len(bits) * 64)))
        none = np.zeros(0, np.uint64)
        for texts in in_slices(batches):
            out = []
            for t in texts:
                words = known.of(t)
                h = np.concatenate([none, *(seeds_of(words, w) for w in widths)])
                p = h >> shift
                out.append(np.unique(h[(bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    # A pair needs ``need`` occurrences of seeds, so at least as many different ones as the least need / n.
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("doc")).withColumn("hits", once(passing)("doc")).filter(F.size("hits") >= (least or 1))
    read = settle(read.withColumn("doc_row", F.monotonically_increasing_id()), "seeded")
    hits = read.select("doc_row", F.explode("hits").alias("seed"))
    parts = probes(seeds, hits).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = (
        hits.withColumn("part", F.pmod(F.xxhash64("doc_row"), F.lit(SALT)).cast("int")).join(parts, ["seed", "part"])
        .groupBy("doc_row", "item_row").agg(F.sum("n").alias("n"), F.first("least").alias("least"))
        .filter("n >= least").select("doc_row", "item_row")
    )
    pairs = settle(pairs, "pairs")

    @F.arrow_udf("covered int, tiles int")
    def tiled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, last, words = WordHashes(), None, None
        for some, texts in in_slices(batches):
            got = []
            for i, d in zip(some, texts):
                if d is not last and d != last:
                    last, words = d, known.of(d)
                got.append(greedy_tiles(known.of(i), words, min_match))
            yield pa.StructArray.from_arrays([pa.array([sum(n for _, _, n in t) for t in got], pa.int32()), pa.array([len(t) for t in got], pa.int32())], ["covered", "tiles"])

    both = read.select("doc_row", "doc_id", "doc").join(pairs, "doc_row").join(items.select("item_row", "item_id", "item", "words"), "item_row")
    done = both.select("doc_id", "item_id", F.col("words").alias("item_words"), F.xxhash64("doc").alias("one"), F.hash("doc").alias("two"), once(tiled)("item", "doc").alias("t"))
    share = F.col("t.covered") / F.col("item_words")
    out = done.select("doc_id", "item_id", "item_words", F.col("t.covered").alias("covered_words"), F.col("t.tiles").alias("tiles"), share.alias("coverage"), "one", "two")
    out = settle(out.filter(F.col("coverage") >= threshold), "leaks")
    discard(items, seeds, read, pairs)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and benchmark row that leaks into it: doc_id, item_id, item_words,
    covered_words, tiles, coverage."""
    return _leaking(docs, benchmark, doc_id, text, item_id, item_text, min_match, threshold).drop("one", "two")


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` into which nothing leaks; each is judged by its own text, whatever its id."""
    one, two = fresh(docs, "one"), fresh(docs, "two")
    found = _leaking(docs, benchmark, doc_id, text, item_id, item_text, min_match, threshold)
    bad = settle(found.select(F.col("one").alias(one), F.col("two").alias(two)).distinct(), "leaking")
    discard(found)
    return docs.join(bad, (F.xxhash64(docs[text]) == bad[one]) & (F.hash(docs[text]) == bad[two]), "left_anti")
