"""Reduction that keeps neighbourhoods: fuzzy neighbour weights, then a spectral layout by power steps over the link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tieline.operators.density import neighbours
from tieline.operators.vectors import unit
from tieline.session import cut_lineage


def fuzzy_links(near: DataFrame, item: str = "vec_id") -> DataFrame:
    """(src, dst, weight), both directions: how surely two items are neighbours.

    An item's nearest neighbour has weight 1; the others fall with the distance beyond it, at a width at which the weights of its k
    neighbours sum to log2(k), found by bisection.  The two views of a pair unite as probabilities do, a + b - ab.
    """
    kind = near.schema[item].dataType
    pair = T.StructType([T.StructField("other", kind), T.StructField("distance", T.DoubleType())])
    # One row an item with its k neighbours: k is a parameter, so a row is bounded.
    lists = near.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("n"))
    lists = lists.select(item, F.transform("n", lambda x: F.struct(x["other"], x["distance"])).cast(T.ArrayType(pair)).alias("n"))

    def weigh(batches):
        for batch in batches:
            held = batch.column(1)
            counts = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            src = np.repeat(np.arange(len(counts)), counts)
            d = flat.field("distance").to_numpy(zero_copy_only=False)
            first = np.full(len(counts), np.inf)
            np.minimum.at(first, src, d)
            beyond = d - first[src]
            goal = np.log2(np.maximum(counts, 2))
            low, high = np.zeros(len(counts)), np.full(len(counts), max(1.0, float(beyond.max(initial=0.0))) * 64)
            for _ in range(64):
                mid = (low + high) / 2
                total = np.bincount(src, np.exp(-beyond / np.maximum(mid[src], 1e-12)), len(counts))
                low, high = np.where(total < goal, mid, low), np.where(total < goal, high, mid)
            w = np.exp(-beyond / np.maximum(high[src], 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src)), flat.field("other"), pa.array(w)], names=["src", "dst", "weight"])

    one_way = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("weight", T.DoubleType())])
    found = lists.mapInArrow(weigh, one_way)
    pairs = found.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("s"), F.product("weight").alias("p"), F.count("*").alias("c"))
    weight = F.col("s") - F.when(F.col("c") > 1, F.col("p")).otherwise(0.0)
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.inline(ways), weight.alias("weight")).where("weight > 0")


def spectral_layout(links: DataFrame, k: int, seed: int = 42, degree: int = 12, tol: float = 1e-3, rounds: int = 100) -> DataFrame:
    """(node, point): the ``k`` slowest modes of a random walk over the links (src, dst, weight; both directions).

    A round filters a block of k + 10 vectors by a Chebyshev polynomial of ``degree`` steps, each one join of the links with the
    vectors and one grouped sum, written to the shared folder, then solves a (k + 10)-square eigenproblem on the driver and turns the block.
    Rounds end when the residual of the k modes is below ``tol``; it raises if ``rounds`` do not suffice.  The constant mode
    is left out; a graph with fewer modes gets zeros.  Vectors start from a hash of ``seed`` and node and are turned to a fixed sign.
    """
    m = k + 10  # spare vectors: the further the first one left out, the fewer rounds
    ps, cs = [f"p{j}" for j in range(m)], [f"c{j}" for j in range(m)]
    mass = cut_lineage(links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")))
    total, n = mass.agg(F.sum("d"), F.count("*")).first()
    if not n:
        return mass.select("node", F.array().cast("array<double>").alias("point"))
    side = lambda c: mass.select(F.col("node").alias(c), F.col("d").alias(f"_{c}"))
    scaled = links.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("_src") * F.col("_dst"))).alias("s"))
    scaled = cut_lineage(scaled)
    # The filter's two numbers ride along as columns, so that every step of every round is the same generated code.
    own = ["root", "centre", "half", *cs, *ps]
    numbers = lambda names: T.StructType([T.StructField("node", mass.schema["node"].dataType), *[T.StructField(c, T.DoubleType()) for c in names]])

    def step(state: DataFrame) -> DataFrame:
        """The columns of ``own`` of each node, and n0, n1, …: the neighbours' c columns, weighted and summed."""
        sent = scaled.join(state.select(F.col("node").alias("dst"), *cs), "dst").select(
            F.col("src").alias("node"), *[(F.col("s") * F.col(c)).alias(f"n{j}") for j, c in enumerate(cs)], *[F.lit(None).cast("double").alias(c) for c in own]
        )
        here = state.select("node", *[F.lit(0.0).alias(f"n{j}") for j in range(m)], *own)
        return sent.unionByName(here).groupBy("node").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(m)], *[F.max(c).alias(c) for c in own])

    def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)

    every = [*cs, *[f"n{j}" for j in range(m)], "root"]
    wide = len(every)

    def products(batches):
        sums = sum((x.T @ x for x in (matrix(b, every) for b in batches)), np.zeros((wide, wide)))
        yield pa.RecordBatch.from_arrays([pa.array(range(wide * wide), pa.int32()), pa.array(sums.ravel())], names=["at", "v"])

    def solved(state: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, float]:
        """The block and its neighbour sums as written, the turn to Ritz vectors, their share of the constant mode, their values, the worst residual of the first k."""
        state = cut_lineage(step(state).select("node", *every))
        # wide² numbers a task, wide² numbers on the driver.
        gram = np.zeros(wide * wide)
        for at, v in state.mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            gram[at] = v
        gram = gram.reshape(wide, wide)
        r = gram[:m, -1]
        inner, moved, square = (g - np.outer(r, r) for g in (gram[:m, :m], (gram[:m, m:-1] + gram[m:-1, :m]) / 2, gram[m:-1, m:-1]))
        size = np.sqrt(np.maximum(np.diag(inner), 1e-300))
        values, basis = np.linalg.eigh(inner / np.outer(size, size))
        good = values > 1e-11 * values[-1]
        basis = basis[:, good] / np.sqrt(values[good]) / size[:, None]
        ritz, z = np.linalg.eigh(basis.T @ moved @ basis)
        ritz, z = ritz[::-1], (basis @ z)[:, ::-1]
        worst = max(np.sqrt(max(0.0, z[:, j] @ (square - 2 * ritz[j] * moved + ritz[j] ** 2 * inner) @ z[:, j])) for j in range(min(k, len(ritz))))
        return state, np.pad(z, ((0, 0), (0, m - z.shape[1]))), r, ritz, worst

    def turned(state: DataFrame, z: np.ndarray, r: np.ndarray, centre: float, half: float) -> DataFrame:
        """The first filter step: the Ritz vectors as p, their shifted and scaled neighbour sums as c."""
        names = ["root", "centre", "half", *cs, *ps]

        def turn(batches):
            for batch in batches:
                rows = matrix(batch, every)
                flat = rows[:, -1:] * (r @ z)  # both sides lose the constant mode, which every step leaves as it is
                x, y = rows[:, :m] @ z - flat, rows[:, m:-1] @ z - flat
                cols = np.concatenate([rows[:, -1:], np.full((len(rows), 1), centre), np.full((len(rows), 1), half), (y - centre * x) / half, x], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in cols.T]], names=["node", *names])

        return state.mapInArrow(turn, numbers(names))

    unit_hash = lambda j: F.xxhash64("node", F.lit(seed), F.lit(j)) / F.lit(2.0**63)
    zero = F.lit(0.0)
    start = mass.select("node", F.sqrt(F.col("d") / F.lit(float(total))).alias("root"), zero.alias("centre"), zero.alias("half"), *[unit_hash(j).alias(c) for j, c in enumerate(cs)], *[zero.alias(p) for p in ps])
    state, z, r, ritz, worst = solved(start)
    wanted = min(k, n - 1)
    for _ in range(rounds):
        if worst <= tol or len(ritz) <= wanted:
            break
        # The filter is small on [-1, cut] and grows beyond it.
        cut = float(np.clip(ritz[-1], -0.5, 0.999))
        now = turned(state, z, r, (cut - 1) / 2, (cut + 1) / 2)
        for _ in range(degree - 1):
            now = step(now)  # names its input twice: written at every step, else the plan doubles with each
            following = [(2 * (F.col(f"n{j}") - F.col("centre") * F.col(f"c{j}")) / F.col("half") - F.col(f"p{j}")).alias(f"c{j}") for j in range(m)]
            now = cut_lineage(now.select("node", "root", "centre", "half", *[F.col(f"c{j}").alias(f"p{j}") for j in range(m)], *following))
        state, z, r, ritz, worst = solved(now)
    else:
        raise RuntimeError(f"the layout did not settle in {rounds} rounds: residual {worst:.1e}")
    kept = min(wanted, len(ritz))
    state = cut_lineage(turned(state, z, r, 0.0, 1.0).select("node", "root", *ps[:kept]))
    signs = state.agg(F.lit(0.0), *[F.sum(F.col(c) * unit_hash(-1)) for c in ps[:kept]]).first()[1:]
    point = [F.col(c) / F.col("root") * F.lit(float(np.copysign(max(ritz[j], 0.0), signs[j]))) for j, c in enumerate(ps[:kept])]
    return state.select("node", F.array(*point, *[F.lit(0.0)] * (k - kept)).alias("point"))


def neighbour_layout(items: DataFrame, k: int = 5, n_neighbours: int = 15, item: str = "vec_id", vec: str = "embedding", cosine: bool = True, seed: int = 42) -> DataFrame:
    """(item, point): ``k`` coordinates in which neighbours of the full space (by angle, or by distance) stay neighbours.

    Item ids are unique.  Null vectors take no part; an item without any neighbour gets zeros; an empty table gives no rows.
    """
    points = items.where(F.col(item).isNotNull() & F.col(vec).isNotNull()).select(item, (unit(F.col(vec)) if cosine else F.col(vec)).alias("point"))
    points = cut_lineage(points.where("point is not null"))
    links = cut_lineage(fuzzy_links(neighbours(points, n_neighbours, item), item))
    places = spectral_layout(links, k, seed).withColumnRenamed("node", item)
    return points.select(item).join(places, item, "left").select(item, F.coalesce("point", F.array(*[F.lit(0.0)] * k)).alias("point"))
