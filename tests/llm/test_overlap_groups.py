"""Large groups of near copies and shingles that only one text has."""

import random
from collections import Counter

import numpy as np

from fieldstone.llm import common, overlap


def test_distances_together_are_those_one_by_one():
    rng = np.random.default_rng(4)
    parities = np.array([overlap.parity(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))) for n in rng.integers(1, 600, 50)], object)
    i, j = rng.integers(0, 50, (2, 9000))
    assert overlap.parity_distances(parities, i, j).tolist() == [overlap.parity_distance(parities[a], parities[b]) for a, b in zip(i, j)]


def test_rows_that_may_pair_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 60, 4000)
    rows = np.array(sorted(zip(rng.integers(0, 900, 4000), n, range(4000), n - rng.integers(0, 1 + n // 5)))).T
    token, n, k, left = rows
    may = set(np.flatnonzero(overlap.may_pair(token, n, left, 0.8)).tolist())
    paired = {int(x) for i, j in overlap.candidate_pairs(token, k, n, k, left, 0.8, True) for x in (*i, *j)}
    assert 500 < len(paired) < 3500 and may == paired


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.choices(words, k=150)
    texts = []
    for i in range(240):  # two or three changed words of 150: some pairs are alike, most are not
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(2, 3)):
            w[at] = f"x{i}y{at}"
        texts.append(" ".join(w))
    texts += [" ".join(rnd.choices(words, k=150)) for _ in range(100)]
    sets = [set(overlap.shingles(overlap.WordHashes(), t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = Counter()

    def settle(df, name):
        out = common.settle(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(overlap, "settle", settle)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = docs.select("text").selectExpr("xxhash64(text) k", "text")
    nodes = docs.selectExpr("xxhash64(text) k", "doc_id node")
    names = overlap.joined(prints, nodes, spark.createDataFrame([], "node long, root long"))
    of = {r.node: r.root for r in names.collect()}
    assert [of.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert len(set(map(find, range(240)))) > 20 and rows["pairs"] < 28_680 / 4  # of so many in the group
    firsts = sum(len(overlap.first_shingles(np.array(sorted(s), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0.8)) for s in sets)
    assert 0 < rows["entries"] < 0.8 * firsts  # those of the single texts go no further
