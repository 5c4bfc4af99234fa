"""The pipeline's near-duplicate stage: candidates of a family grow in proportion, links are those of brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tieline.llm import simhash
from tieline.session import cut_lineage


def family(spark, n, shared, own, seed=1):
    """``n`` texts that have ``shared`` of their words in common and ``own`` words each of their own."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(shared)]
    rows = [(i, " ".join([*base, *(f"o{i}x{j}" for j in range(own))])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def nodes_of(docs):
    prints = cut_lineage(simhash._set_prints(docs, 5))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "content"))
    return cut_lineage(prints.groupBy("node").agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))


def test_a_family_below_the_threshold_stays_linear(spark, monkeypatch):
    """Texts at a similarity of a half share keys, but past the first heads no two of them become a pair."""
    pairs = []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    found = {}
    for n in (500, 2000):
        docs = family(spark, n, 104, 50)
        pairs.clear()
        assert simhash.similar(docs, nodes_of(docs)).count() == 0
        found[n] = sum(pairs)
        assert sum(pairs[1:]) == 0
    assert 0 < found[2000] <= 32 * 2000 and found[2000] < 6 * found[500]


def test_links_of_a_borderline_family(spark):
    """Copies with words changed at random, about the threshold: the components are those of all pairs compared."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [[f"c{i}x{j}" if draw.random() < 0.018 else w for j, w in enumerate(base)] for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sets = [set(simhash.shingle_set(" ".join(t).encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                close += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert 100 < close < 150 * 149 / 4
    want = sorted({find(i) for i in range(len(texts))})
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_rarest_shingles_meet_for_every_similar_pair(spark):
    draws = np.random.default_rng(0)
    base = draws.integers(0, 1000, (6, 60))
    sets = {i: np.unique(np.r_[base[i % 6][draws.random(60) > 0.12 * draws.random()], draws.integers(0, 99, i % 4)].astype(np.uint64)) for i in range(120)}
    table = spark.createDataFrame([(i, bytearray(g.tobytes())) for i, g in sets.items()], "node bigint, grams binary")
    at = {}
    for r in simhash._prefixes(table, 80).collect():
        assert r["n"] == len(sets[r["node"]])
        at.setdefault(r["node"], set()).add(r["gram"])
    met = 0
    for i in sets:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                met += 1
                assert at[i] & at[j]
    assert met > 10


def test_a_pair_without_a_common_key_is_linked(spark):
    """Two texts of nine runs, eight of them shared: a similarity of 0.8, but none of the 32 keys in common."""
    words = [f"{a}465298" for a in "abcdefghijklm"]
    one, two = (" ".join([*words[:12], last]) for last in (words[12], "z465298"))
    grams = [simhash.shingle_set(t.encode(), 5) for t in (one, two)]
    assert not set(simhash.band_keys(grams[0])) & set(simhash.band_keys(grams[1]))
    assert len(np.intersect1d(*grams)) == 8 and len(np.union1d(*grams)) == 10
    rows = [(1, one), (2, two), *((i, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(3, 9))]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_similar_sets_share_their_first_shingles():
    draws = np.random.default_rng(3)
    for n in (1, 4, 9, 40, 160, 900):
        for _ in range(40):
            gone, new = draws.integers(0, n // 9 + 1, 2)
            one = np.unique(draws.integers(0, 1 << 62, n).astype(np.uint64))
            two = np.unique(np.r_[one[gone:] if draws.random() < 0.5 else draws.permutation(one)[gone:], draws.integers(0, 1 << (62 if draws.random() < 0.5 else 50), new).astype(np.uint64)])
            both = len(np.intersect1d(one, two))
            if 100 * both >= 80 * len(np.union1d(one, two)):
                early = np.intersect1d(simhash.first_shingles(one, 80), simhash.first_shingles(two, 80))
                assert len(early) >= min(simhash._FIRST, -(-len(one) * 80 // 100), -(-len(two) * 80 // 100))
