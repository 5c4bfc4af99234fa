"""Density clusters against brute force: neighbours, forest, planted groups."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieline.operators import density, vectors


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rows)], "vec_id bigint, point array<double>").repartition(4)


def planted(n, seed=0, dims=3):
    """Four groups of unequal size and density, and a tenth of scattered points; their true labels (-1: scattered)."""
    draw = np.random.default_rng(seed)
    shares, spreads = (0.4, 0.25, 0.15, 0.1), (0.25, 0.6, 0.15, 0.4)
    mids = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 7]], float)[:, :dims]
    parts = [mids[g] + s * draw.standard_normal((int(n * p), dims)) for g, (p, s) in enumerate(zip(shares, spreads, strict=True))]
    truth = np.repeat([0, 1, 2, 3], [len(p) for p in parts])
    rest = draw.uniform(-12, 18, (n - len(truth), dims))
    return np.vstack([*parts, rest]), np.r_[truth, np.full(len(rest), -1)]


def rand_index(a, b):
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    m = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(m, (a, b), 1)
    two = lambda x: (x * (x - 1) / 2).sum()
    s, r, c, t = two(m), two(m.sum(1)), two(m.sum(0)), two(np.array([m.sum()]))
    return (s - r * c / t) / ((r + c) / 2 - r * c / t)


def labels_of(df, n, out="cluster"):
    got = dict(df.select("vec_id", out).collect())
    return np.array([got[i] for i in range(n)])


def test_neighbours_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK_ROWS", 40)  # many cells, and parts of the crowded one
    draw = np.random.default_rng(2)
    rows = np.vstack([draw.standard_normal((150, 3)), 9 + draw.standard_normal((60, 3)) / 9, np.ones((120, 3))])
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    want = {(i, int(j), round(float(d[i, j]), 9)) for i in range(len(rows)) for j in [j for j in np.lexsort((np.arange(len(rows)), d[i])) if j != i][:5]}
    got = {(r[0], r[1], round(r[2], 9)) for r in density.neighbours(table(spark, rows), 5).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, 20_000])
def test_forest_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(density, "FEW_EDGES", few)
    draw = np.random.default_rng(5)
    edges = [(int(u), int(v), float(draw.integers(1, 9))) for u, v in draw.integers(0, 60, (150, 2)) if u != v]
    edges = [(min(u, v), max(u, v), w) for u, v, w in edges]
    got = density.spanning_forest(spark.createDataFrame(edges, "u bigint, v bigint, w double")).collect()
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    total = n = 0
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        a, b = find(u), find(v)
        if a != b:
            root[b], total, n = a, total + w, n + 1
    assert len(got) == n and sum(r["w"] for r in got) == total


@pytest.mark.parametrize("n", [200, 1200])
def test_planted_groups(spark, n):
    """Groups of unequal size and density are found at two table sizes; at the smaller one an outlier moves no label."""
    rows, truth = planted(n)
    clusters = lambda points: labels_of(density.density_clusters(table(spark, points), max(12, n // 50), 8), len(points))
    found = clusters(rows)
    real = truth >= 0
    assert rand_index(truth[real], found[real]) >= 0.9
    assert len(set(found[real & (found >= 0)])) == 4 and (found[~real] == -1).mean() > 0.5
    if n == 200:
        after = clusters(np.vstack([rows, [[1e6, -1e6, 1e6]]]))
        assert rand_index(found, after[:n]) > 0.99 and after[n] == -1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, point array<double>")
    assert density.density_clusters(empty, 5).count() == 0
    few = table(spark, [[0.0, 0.0]] * 3)
    assert {r["cluster"] for r in density.density_clusters(few, 5).collect()} == {-1}
    alike = table(spark, [[0.0, 0.0]] * 30 + [[5.0, 5.0]] * 30).unionByName(empty.select(F.lit(99).cast("bigint").alias("vec_id"), F.lit(None).cast("array<double>").alias("point")))
    got = dict(density.density_clusters(alike, 10, 5).collect())
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 60)} == {1}
    assert vectors.density_clusters is density.density_clusters


def test_visits_grow_with_the_rows(spark, monkeypatch):
    """Points without structure visit the cells around them, not all; copies are one site."""
    monkeypatch.setattr(density, "BLOCK_ROWS", 100)
    visits, real = [], density.cut_lineage

    def counted(df):
        out = real(df)
        if "far" in out.columns:
            visits.append(out.count())
        return out

    monkeypatch.setattr(density, "cut_lineage", counted)
    draw = np.random.default_rng(3)
    for n in (1000, 4000):
        assert density.neighbours(table(spark, draw.uniform(0, 1, (n, 2))), 3).count() == 3 * n
    assert visits[0] < 4 * 1000 and visits[1] < 4 * 4000  # of 20 and 80 cells
    copies = density.neighbours(table(spark, [[1.0, 2.0]] * 3000 + [[3.0, 4.0]]), 3)
    assert sorted({r["other"] for r in copies.where("vec_id < 3000").collect()}) == [0, 1, 2, 3] and visits[2] <= 3


def test_sizes_go_through_the_levels_together(spark):
    points = table(spark, planted(300, 4)[0])
    forest = density.spanning_forest(density.reachability(density.neighbours(points, 6)))
    both = density.condensed_at(points, forest, {"a": 40, "b": 8})
    for out, size in (("a", 40), ("b", 8)):
        alone = density.condensed_clusters(points, forest, size, out=out)
        assert (labels_of(both, 300, out) == labels_of(alone, 300, out)).all()
    assert len(set(labels_of(both, 300, "b"))) > len(set(labels_of(both, 300, "a"))) > 2


def test_the_norm_is_summed_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<double>").repartition(1)
    unit = rows.select("i", vectors.unit(F.col("v")).alias("u"))
    assert sorted((r["i"], r["u"]) for r in unit.collect()) == [(1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, None)]
    long = spark.range(2000).repartition(1).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: x.cast("double")).alias("v"))
    began = time.time()
    assert round(long.select(F.sum(F.get(vectors.unit(F.col("v")), F.lit(0)))).first()[0], 3) > 0
    assert time.time() - began < 30  # 8 billion products before
