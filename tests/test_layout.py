"""Neighbour layouts: fuzzy weights by definition, modes against a dense solver, neighbourhoods of a rolled-up sheet."""

import math

import numpy as np
from pyspark.sql import functions as F

from tieline.operators import layout, vectors
from tieline.operators.density import neighbours
from tests.conftest import rows


def trustworthiness(full, low, k):
    """One minus the rank-weighted share of neighbours in ``low`` that are none in ``full``."""
    n = len(full)
    far = lambda x: np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * n)
    rank = far(full).argsort(axis=1).argsort(axis=1) + 1
    near = far(low).argsort(axis=1)[:, :k]
    excess = np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()
    return 1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * excess


def sheet(n, seed=3):
    """A sheet rolled up one and a half times, about as long as high."""
    rng = np.random.default_rng(seed)
    t = 1.5 * math.pi + 3 * math.pi * rng.random(n)
    return np.stack([t * np.cos(t), 60 * rng.random(n), t * np.sin(t)], axis=1)


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")


def test_rolled_sheet_keeps_neighbours(spark):
    x = sheet(700)
    df = table(spark, x)
    out = sorted(layout.neighbour_layout(df, 2, 10, cosine=False).collect())
    low = np.array([r["point"] for r in out])
    pca = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    ours, plain = trustworthiness(x, low, 10), trustworthiness(x, (x - x.mean(axis=0)) @ pca.T, 10)
    assert [r["vec_id"] for r in out] == list(range(700)) and ours >= 0.9 and ours > plain + 0.02, (ours, plain)


def test_modes_equal_a_dense_solver(spark):
    x = sheet(60)
    near = neighbours(table(spark, x).withColumnRenamed("embedding", "point"), 6)
    links = layout.fuzzy_links(near).cache()
    w = np.zeros((60, 60))
    for r in links.collect():
        w[r["src"], r["dst"]] = r["weight"]
    # Weights by their definition.
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    one = np.zeros_like(w)
    for i in range(60):
        nb = [j for j in d[i].argsort() if j != i][:6]
        beyond = d[i, nb] - d[i, nb[0]]
        low, high = 0.0, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(-beyond / mid).sum() < math.log2(6) else (low, mid)
        one[i, nb] = np.exp(-beyond / high)
    assert np.allclose(w, one + one.T - one * one.T, atol=1e-6)
    mass = w.sum(axis=1)
    values = np.linalg.eigvalsh(w / np.sqrt(np.outer(mass, mass)))[::-1]
    got = np.array([r["point"] for r in sorted(layout.spectral_layout(links, 3, tol=1e-5).collect())])
    walk = w / mass[:, None]
    for j in range(3):
        assert np.abs(walk @ got[:, j] - values[j + 1] * got[:, j]).max() < 1e-4 * np.abs(got[:, j]).max()


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id bigint, embedding array<double>")
    out = layout.neighbour_layout(df, 2, 3)
    assert [r["vec_id"] for r in sorted(out.collect())] == [1, 2] and all(len(r["point"]) == 2 for r in out.collect())
    assert rows(layout.neighbour_layout(df.limit(0), 2, 3), "vec_id") == []
    assert [r["point"] for r in layout.neighbour_layout(df.where("vec_id = 1"), 2, 3).collect()] == [[0.0, 0.0]]
    same = spark.range(8).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert layout.neighbour_layout(same, 2, 3).where(F.expr("exists(point, v -> isnan(v))")).count() == 0
