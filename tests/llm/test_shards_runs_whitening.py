"""Shuffled shards, periodic runs and whitening against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieline.llm import queries, repetitions, sharding, whitening
from tieline.session import work_dir

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "a b " * 40, "x " * 3000, "same", "same", "漢字 é\x1cz \x0b q", "la la la la la la la la la la la la la"]
DOCS = "doc_id bigint, text string, shard string, slot string, row string, words string, runs string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "x", "x", "x", "x") for i, t in enumerate(ODD)] + [(3, "one", "", "", "", "", "")] * 5 + [(None, "no id", *[None] * 5)] * 3 + [(None, None, *[None] * 5)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 4097])
def test_permutation(n):
    at = sharding.permute(range(n), n, 5)
    assert sorted(at) == list(range(n))
    assert sharding.restore(at, n, 5).tolist() == list(range(n))
    assert n < 97 or sharding.permute(range(n), n, 6).tolist() != at.tolist()
    for row in range(0, n, 13):
        shard, slot = sharding.place(row, n, 8, 5)
        assert sharding.row_at(shard, slot, n, 8, 5) == row


def test_permutation_moves_rows_evenly():
    """Neighbours do not stay together: over many seeds a row falls into each shard about equally often."""
    seen = Counter(int(sharding.permute([3], 1000, s)[0]) % 8 for s in range(800))
    assert max(seen.values()) < 150 and min(seen.values()) > 60


def check_shards(got, rows, shards):
    raw = [(d, (t or "").encode()) for d, t in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(b) + 1, zlib.crc32(b)) for d, b in raw)
    assert sorted(r["row"] for r in got) == list(range(len(rows)))
    slots = defaultdict(list)
    for r in got:
        assert (r["shard"], r["slot"]) == sharding.place(r["row"], len(rows), shards)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["row"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_shards(spark, docs, real):
    for df in (docs, real):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sharding.shard_documents(df).collect()
        check_shards(got, rows, 8)
        again = sharding.shard_documents(df.repartition(7).orderBy(F.rand(1))).collect()
        assert Counter(got) == Counter(again)
        assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_one_repeated_row_is_dealt_over_all_tasks(spark):
    hot = spark.range(4000).select(F.lit(7).cast("bigint").alias("k"))
    placed, n = sharding.numbered(hot, ["k"], 8)
    assert n == 4000 and sorted(r["row"] for r in placed.collect()) == list(range(4000))
    # Equal keys are split over the ranges by where they stand: none of the eight holds much more than its share.
    loads = sharding.in_ranges(hot, ["k"], 8).groupBy(F.shiftright("_at", 33)).count().collect()
    assert len(loads) == 8 and max(r["count"] for r in loads) < 1000


def test_shards_on_disk(spark, real):
    path = work_dir(spark, "shards")
    back = sharding.write_shards(real, path, shards=4, rows_per_file=20)
    n = real.count()
    assert back.drop("shard", "slot").exceptAll(real).count() == 0 and back.count() == n
    got = sharding.shuffle_rows(sharding.document_digests(real), ["doc_id", "digest"], 4)
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in got.collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == want
    with pytest.raises(ValueError):
        sharding.write_shards(real.withColumn("slot", F.lit(1)), path)


def brute_runs(words, least):
    out, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                part = words[i : i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i) + 1
    return sorted(out)


def test_runs_of_random_words():
    draw = random.Random(12)
    for _ in range(1500):
        n, kinds = draw.randint(0, 70), draw.choice([1, 2, 3, 6])
        words = [draw.randrange(kinds) for _ in range(n)]
        if n and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + draw.randrange((n - a) // 2 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            assert repetitions.find_runs(np.asarray(words, np.int64), least) == brute_runs(words, least)


def test_large_classes_take_places_one_by_one():
    big = list(range(0, 4000, 2))
    joined, pairs = repetitions._joined(big.copy(), [5, 7, 3999])
    assert joined == sorted([*big, 5, 7, 3999])
    want = [(x, y) for x, y in zip(joined, joined[1:], strict=False) if (x in {5, 7, 3999}) != (y in {5, 7, 3999})]
    assert sorted(pairs) == want


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_digests(spark, docs, real):
    short = real.where(F.length("text") < 1500)
    planted = docs.select(F.explode(F.sequence(F.lit(0), F.lit(40))).alias("doc_id"), "text")
    for df in (docs.where(F.coalesce(F.length("text"), F.lit(0)) < 3000), short, planted.where(F.coalesce(F.length("text"), F.lit(0)) < 300)):
        got = repetitions.run_digests(repetitions.repetitions(repetitions.plant_periods(df)))
        want = Counter(brute_digest(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in got.select(COLUMNS).collect()) == want
    assert repetitions.run_digests(repetitions.repetitions(repetitions.plant_periods(empty(spark)))).count() == 0


def test_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "w " * 200_000)], "doc_id bigint, text string")
    row = repetitions.repetitions(df).first()
    assert row["runs"] == [(0, 200_000, 1)] and row["collapsed"] == "w"


def whitened_by_hand(rows, k):
    x = np.floor(1024 * np.asarray(rows, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(v)


def check_whitening(got, ids, rows, k):
    n, deviation, white, explained = whitened_by_hand(rows, k)
    k = white.shape[1]
    assert len(got) == len(rows) * k
    table = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, vec_id in enumerate(ids):
        for c in range(k):
            r = table[vec_id, c + 1]
            assert r["n"] == n and r["deviation"] == deviation[i]
            assert abs(r["explained"] - explained[c]) < 1e-9 * explained[c] and r["identity_error"] < 1e-9
            if abs(white[i, c]) > 1e-6:
                signs.setdefault(c, np.sign(white[i, c] * r["whitened"]))
            assert abs(r["whitened"] * signs.get(c, 1) - white[i, c]) < 1e-6


def test_whitening(spark):
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in real.collect()]
    check_whitening(queries.op13_whiten(spark, SF).collect(), *zip(*rows, strict=True), 8)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, d int, n int, component string"
    draws = np.random.default_rng(3).standard_normal((40, 5)) * [9, 5, 3, 2, 1]
    good = [(i, [float(np.float32(c)) for c in v], 1, 1, "x") for i, v in enumerate(draws)]
    bad = [(100, None, 1, 1, ""), (101, [], 1, 1, ""), (102, [1.0, None, 0.0, 0.0, 0.0], 1, 1, ""), (103, [float("nan")] * 5, 1, 1, ""), (104, [float("inf")] * 5, 1, 1, ""), (None, None, 1, 1, "")]
    df = spark.createDataFrame(good + bad, schema).repartition(4)
    check_whitening(whitening.whiten(df).collect(), [g[0] for g in good], [g[1] for g in good], 8)
    # Another dimension is fitted by itself; equal vectors have no component; repeated rows stay.
    more = spark.createDataFrame([(200 + i, [float(i), 0.5], 1, 1, "") for i in range(6)] + [(300, [7.0] * 3, 1, 1, "")] * 4, schema)
    got = whitening.whiten(df.unionByName(more).unionByName(df)).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({g[0]: 10 for g in good}) + Counter({200 + i: 1 for i in range(6)})
    assert {r["n"] for r in got if r["vec_id"] < 100} == {80} and {r["n"] for r in got if r["vec_id"] >= 200} == {6}
    assert whitening.whiten(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 1, 1, "")], schema)).count()


def test_deviations_beyond_64_bit_steps():
    x, s = np.array([[1 << 31], [0]], np.int64), np.array([1 << 31], np.int64)
    assert whitening._deviations(x, 2, s).tolist() == [(1 << 31) ** 2] * 2
    with pytest.raises(OverflowError):
        whitening._deviations(x * 4, 2, s * 4)


@pytest.mark.parametrize("kind", ["spread", "equal", "low rank", "pairs"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigensolver(kind, d):
    draws = np.random.default_rng(d)
    basis = np.linalg.qr(draws.standard_normal((d, d)))[0]
    spectrum = {"spread": np.logspace(0, -5, d), "equal": np.ones(d), "low rank": np.r_[np.ones(min(d, 3)), np.zeros(max(d - 3, 0))], "pairs": np.repeat(np.arange(d, 0, -1.0), 2)[:d]}[kind]
    v = basis @ np.diag(spectrum) @ basis.T
    values, vectors = whitening.leading_components(v, 8)
    want = np.sort(spectrum)[::-1][:8]
    assert len(values) == (want > 0).sum() and np.allclose(values, want[: len(values)], rtol=1e-9, atol=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-12 * np.trace(v)


def test_sturm_counts():
    diagonal, off = np.array([2.0, -1.0, 0.5, 3.0]), np.array([1.0, 0.0, 2.0])
    w = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.array([-5.0, -1.2, 0.0, 1.0, 2.5, 9.0])
    assert whitening.count_below(diagonal, off, at).tolist() == [(w < x).sum() for x in at]
