"""SimHash near-duplicates, searched with BK-trees.

A text's 64-bit fingerprint has bit b set if over half of its word-shingle hashes have it.  Texts
whose fingerprints differ in at most three bits are linked; connected texts form a component.

Search.  Only distinct fingerprints are searched, so exact copies cost nothing.  The 64 bits are cut
into blocks; two fingerprints within the radius agree on at least ``blocks - radius`` whole blocks,
so each fingerprint is dealt to one shard per choice of that many blocks and every pair within the
radius meets in some shard.  Each shard is a BK-tree: children are keyed by their integer Hamming
distance to the parent and a search follows only the edges within the radius.  The trees are built in
the tasks that own the shards rather than broadcast: fingerprints of all documents have no proven
bound.  A shard with very many fingerprints is cut again by blocks of the bits that it leaves open, and so on:
each cut halves the open bits, so that no task holds an unbounded shard and no link is lost.  A shard emits
only a spanning forest of its links, so output stays linear in its size.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; very long texts are
read whole; rows that share a doc_id are one document; rows without an id take part in links, and a component of such
rows alone has a null id; other columns, whatever their names, are kept by ``keep_one`` and play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, in_slices, settle

RADIUS = 3
CHUNK = 2048


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    one = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(one, shingles), np.uint64, n).astype("<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in in_slices(batches):
        yield pa.array(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a long with the same 64 bits."""
    return _fingerprint(text)


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BkTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, points: np.ndarray):
        self.points, self.values = points, points.tolist()
        self.children: list[dict[int, int]] = [{} for _ in self.values]
        for i in range(1, len(self.values)):
            node, value = 0, self.values[i]
            while True:
                d = (value ^ self.values[node]).bit_count()
                below = self.children[node].get(d)
                if below is None:
                    self.children[node][d] = i
                    break
                node = below

    def within(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node the later points within the radius; all points search together, and each
        goes down only the edges whose key is within the radius of its own distance."""
        todo = [(0, np.arange(len(self.values)))]
        while todo:
            node, asking = todo.pop()
            d = np.bitwise_count(self.points[asking] ^ self.points[node]).astype(np.int64)
            near = asking[(d <= radius) & (asking > node)]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                follow = asking[np.abs(d - key) <= radius]
                if len(follow):
                    todo.append((child, follow))


def spanning_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(point, root) for each point that the links join to an earlier root."""
    parent = list(range(len(points)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(points) == 2:
        links = [(0, [1])] if (int(points[0]) ^ int(points[1])).bit_count() <= radius else []
    else:
        links = BkTree(points).within(radius)
    for node, near in links:
        for other in near:
            a, b = find(node), find(int(other))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(i, r) for i in range(len(points)) if (r := find(i)) != i]


def block_masks(blocks: int, radius: int = RADIUS, within: int = (1 << 64) - 1) -> list[int]:
    """Masks over the bits of ``within``: one for each choice of ``blocks - radius`` of as many blocks of these bits."""
    bits = [1 << b for b in range(64) if within >> b & 1]
    part = [sum(bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(x) for x in combinations(part, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose shards hold a few of ``n`` even fingerprints each."""
    blocks = radius + 1
    while n > 4 << (64 * (blocks - radius) // blocks) and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(points: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> list[DataFrame]:
    """From distinct longs ``fp``: parts of a table (fp, mask, shard), so that any two fingerprints within the radius meet in a
    shard.  The fingerprints of a shard agree on the bits of its mask.  Shards of over ``chunk`` are dealt anew by masks that
    hold, beside their own, half of the bits left open, until none is so large or no bits can be cut."""
    blocks = blocks or blocks_for(points.count(), radius)
    fp, every = F.col("fp"), (1 << 64) - 1
    shard = lambda above, mask: F.xxhash64(above, mask, fp.bitwiseAND(mask))
    dealt = points.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, radius)])).alias("mask"))
    dealt = dealt.withColumn("shard", shard(F.lit(0).cast("bigint"), F.col("mask")))
    out = []
    while True:
        large = settle(dealt.groupBy("shard", "mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk), "full-shards")
        masks = [r[0] & every for r in large.select("mask").distinct().collect()]  # of a fixed number of choices
        cut = {m: block_masks(2 * radius, radius, every & ~m) for m in masks if 64 - m.bit_count() >= 2 * radius}
        if not cut:
            return [*out, dealt]
        large = large.filter(F.col("mask").isin([_signed(m) for m in cut]))
        out.append(dealt.join(large.select("shard"), "shard", "left_anti"))
        finer = dealt.sparkSession.createDataFrame([(_signed(m), _signed(m | x)) for m in cut for x in cut[m]], "mask long, finer long")
        again = dealt.join(large.select("shard"), "shard", "left_semi").join(F.broadcast(finer), "mask")  # a fixed number of choices
        dealt = settle(again.select("fp", F.col("finer").alias("mask"), shard(F.col("shard"), F.col("finer")).alias("shard")), "shards")


def links(points: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """From distinct longs ``fp``: pairs (a, b) that span the same components as all pairs of
    fingerprints within the radius."""
    dealt = reduce(DataFrame.unionByName, shards(points, radius, blocks, chunk))
    keyed = dealt.select(F.col("shard").alias("grp"), "fp").repartition("grp").sortWithinPartitions("grp", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(g: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(g)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(g)]))
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    some = np.unique(p[s:e])
                    for i, r in spanning_links(some.view(np.uint64), radius):
                        a.append(int(some[i]))
                        b.append(int(some[r]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            g = np.concatenate((held_g, batch.column(0).to_numpy(zero_copy_only=False)))
            p = np.concatenate((held_p, batch.column(1).to_numpy(zero_copy_only=False)))
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if last:
                yield linked(g[:last], p[:last])
            held_g, held_p = g[last:], p[last:]
        if len(held_g):
            yield linked(held_g, held_p)

    return keyed.select("grp", "fp").mapInArrow(search, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether each node u has one edge (u, v), and no v is such a node."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    inner = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return several.union(inner).isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds until all edges lead to roots; every round is a join and two grouped
    minima, written to the shared folder before the next, as is the result."""
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        after = settle(small, "edges")
        discard(now)
        now = after
    roots = now.toDF("node", "root")
    out = settle(roots.union(roots.select("root", "root").distinct()), "connected")
    discard(now)
    return out


def _labelled(docs: DataFrame, text: str, doc_id: str, radius: int, more) -> DataFrame:
    """Per row: doc_id, fp, k (a hash of the text), and best, the least ``_place`` of the component; settled.  Components are
    gathered per fingerprint, so rows are joined by theirs alone."""
    found = [F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"), F.xxhash64(text).alias("k")]
    prints = settle(docs.select(*found), "simhash")
    points = settle(prints.groupBy("fp").agg(F.min(_place()).alias("best")), "points")
    shared = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    same = prints.join(shared, "doc_id").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    labels = connected(links(points.select("fp"), radius).union(same))
    if more:
        nodes = prints.groupBy("k").agg(F.min("fp").alias("node"))
        labels = more(docs.select(F.xxhash64(text).alias("k"), F.col(text).alias("text")), nodes, labels)
    rooted = points.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    of = settle(rooted.select("fp", "root").join(best, "root").select("fp", "best"), "components")
    out = settle(prints.join(of, "fp").select("doc_id", "fp", "k", "best"), "labelled")
    discard(prints, points, labels, of)
    return out


def _place() -> Column:
    """The order of rows: by id, those without one last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, more=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id, the smallest doc_id reachable.
    ``more``, such as ``overlap.joined``, joins components by other links: from texts, their fingerprints and the
    components' roots."""
    return _labelled(docs, text, doc_id, radius, more).select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, more=None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest id, of rows that share this id,
    and of components without ids, the one with the smallest text hash; of equal ones any."""
    found = _labelled(docs, text, doc_id, radius, more)
    key, k, n = fresh(docs, "key"), fresh(docs, "k"), fresh(docs, "n")
    rows = found.groupBy("best", "doc_id", "k").agg(F.count(F.lit(1)).alias(n))
    rows = rows.select(F.col("doc_id").alias(key), F.col("k").alias(k), n, F.col("best").eqNullSafe(_place()).alias("stays"), F.coalesce(F.col("doc_id") != F.col("best.doc_id"), F.lit(False)).alias("whole"))
    # All rows of a lost id go; of an id that stays, and of rows without one, those with another text.
    ids = settle(found.filter(F.col("doc_id") != F.col("best.doc_id")).select(F.col("doc_id").alias(key)).distinct(), "dropped")
    lost = settle(rows.filter(~F.col("stays") & ~F.col("whole")).select(key, k), "dropped-texts")
    again = settle(rows.filter(F.col("stays") & (F.col(n) > 1)).select(key, k), "repeated")
    discard(found)
    at = lambda t: docs[doc_id].eqNullSafe(t[key]) & (F.xxhash64(docs[text]) == t[k])
    kept = docs.join(ids, docs[doc_id] == ids[key], "left_anti")
    if not lost.isEmpty():
        kept = kept.join(lost, at(lost), "left_anti")
    if again.isEmpty():
        return kept
    twice = docs.join(again, at(again), "left_semi").groupBy(F.col(doc_id).alias(key), F.xxhash64(text).alias(k)).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(n))
    return kept.join(again, at(again), "left_anti").unionByName(twice.select(f"{n}.*"))
