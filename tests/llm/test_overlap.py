"""Links by exact overlap against all pairs."""

import random

import numpy as np

import corpus_pipeline
from fieldstone.llm import overlap, simhash
from fieldstone.llm.decontam import WordHashes


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (60, 70), (100, 130), (900, 1100)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        assert overlap.parity_distance(overlap.parity(a), overlap.parity(b)) <= len(np.setxor1d(a, b))
        assert overlap.parity_distance(overlap.parity(a), overlap.parity(a)) == 0


def test_stage_drops_near_copies_beyond_the_radius(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(20, 200))) for _ in range(40)]
    for t in texts[:30]:  # a block of new words in the middle leaves 0.8 or a little less
        w = t.split()
        for share in (0.05, 0.1, 0.2):
            n = max(1, int(share * len(w)) - 2)
            texts.append(" ".join(w[: len(w) // 2] + [f"new{n}x{i}" for i in range(n)] + w[len(w) // 2 + n :]))
    texts += ["one two", "one two", "one two three", "", None]
    known = WordHashes()
    sets = [set(overlap.shingles(known, t).tolist()) for t in texts]
    prints = [simhash.simhash(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    beyond = 0
    for i in range(len(texts)):
        for j in range(i):
            alike = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
            near = (prints[i] ^ prints[j]).bit_count() <= 3
            beyond += alike and not near
            if alike or near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert beyond > 20 and kept == {find(i) for i in range(len(texts))}


def test_pairs_without_enough_to_share_are_not_made():
    """Every pair as alike as asked for is a candidate by its first common shingle; many others, sharing a late one, are not."""
    rng = np.random.default_rng(5)
    none, order = np.zeros(0, np.uint64), rng.permutation(1 << 14).astype(np.uint64)
    sets = [np.sort(rng.choice(order, 100, replace=False)) for _ in range(60)]
    for s in sets[:20]:
        sets += [np.unique(np.concatenate((s[:-k], rng.integers(1 << 20, 1 << 21, k, dtype=np.uint64)))) for k in (3, 8, 10, 11, 12, 20)]
    rows = []
    for k, s in enumerate(sets):
        first = overlap.first_shingles(s, none, np.zeros(0, np.int64), 0.8)
        rows += [(int(t), k, len(s), k, len(s) - at) for at, t in enumerate(first)]
    rows = np.array(sorted(rows, key=lambda r: (r[0], r[2], r[1]))).T
    pairs = {tuple(sorted((int(rows[1][i]), int(rows[1][j])))) for x, y in overlap.candidate_pairs(*rows, 0.8, True) for i, j in zip(x, y)}
    alike, share = set(), set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                alike.add((i, j))
            if np.intersect1d(overlap.first_shingles(sets[i], none, none, 0.8), overlap.first_shingles(sets[j], none, none, 0.8)).size:
                share.add((i, j))
    assert len(alike) > 50 and alike <= pairs and len(pairs) < 0.75 * len(share)
