"""Operator 8: exact top-k inner products by norm buckets with local cosine thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.session import cut_lineage

SCORES = "query_id bigint, vec_id bigint, score bigint"
_SLACK = 1e-9


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm, dims): components floor(scale * x); vectors that are null or hold nulls or non-finite numbers go."""
    whole = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = vectors.where(F.col("embedding").isNotNull() & F.forall(whole, fine))
    v = F.transform(whole, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    rows = ok.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "v", F.sqrt(square).alias("norm"), F.size("v").alias("dims"))


def _blocks(rows: DataFrame, group: list[Column], size: int, names: list[str]) -> DataFrame:
    """Rows packed into one row a block of about ``size`` vectors: ids, components and norms as bytes.

    A group's blocks are numbered by hash, so a length that very many vectors share is many blocks.
    """
    rows = rows.select("vec_id", "v", "norm", *[g.alias(n) for g, n in zip(group, names, strict=True)])
    counts = rows.groupBy(*names).agg(F.ceil(F.count("*") / size).cast("bigint").alias("parts"))
    rows = rows.join(counts, names).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    schema = ", ".join([*(f"{n} bigint" for n in names), "part bigint, ids binary, comps binary, longest double"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True])
        comps = np.stack(pdf["v"].to_numpy()).astype("<i8") if key[0] else np.zeros((len(pdf), 0), "<i8")
        return pd.DataFrame([[*key, pdf["vec_id"].to_numpy("<i8").tobytes(), comps.tobytes(), float(pdf["norm"].iloc[0])]], columns=[*names, "part", "ids", "comps", "longest"])

    return rows.groupBy(*names, "part").applyInPandas(pack, schema)


def _unpack(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.comps, "<i8").reshape(len(ids), dims)


class _Bucket:
    """Vectors of one block, longest first, with coordinate lists sorted on first use."""

    def __init__(self, ids: np.ndarray, comps: np.ndarray):
        self.ids, self.comps = ids, comps
        real = comps.astype(np.float64)
        self.norms = np.sqrt((real * real).sum(axis=1))
        self.unit = real / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        # Doubles hold the products exactly while every partial sum stays below 2**53.
        self.largest = float(np.abs(real).max(initial=0.0))
        self.real = real
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (order, self.unit[order, f])
        return self.lists[f]

    def candidates(self, q: np.ndarray, norm: float, floor: float) -> np.ndarray:
        """Positions of vectors whose product with ``q`` may reach ``floor``."""
        if floor <= 0 or norm == 0:
            return np.arange(len(self.ids))
        # Length pruning: |q||v| >= floor holds for a prefix of the lengths.
        prefix = int(np.searchsorted(-self.norms, -(floor / norm) * (1 - _SLACK), side="right"))
        if not prefix:
            return np.arange(0)
        # Coordinate pruning: with the bucket's local cosine threshold t a unit vector's coordinate lies near t * q_f.
        t = min(1.0, floor / (norm * self.norms[0]) * (1 - _SLACK))
        unit = q / norm
        best, chosen = prefix, None
        for f in np.argsort(-np.abs(unit))[:3]:
            c = float(unit[f])
            reach = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - c * c)) + _SLACK
            order, values = self.by_coordinate(int(f))
            lo = 0 if c * t - reach < -1 or -t > c else int(np.searchsorted(values, c * t - reach, side="left"))
            hi = len(values) if c > t else int(np.searchsorted(values, c * t + reach, side="right"))
            lo = 0 if c < -t else lo
            if hi - lo < best:
                best, chosen = hi - lo, order[lo:hi]
        if chosen is None:
            return np.arange(prefix)
        return chosen[chosen < prefix]

    def products(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(q) * self.largest * float(np.abs(q).max(initial=0)) < 2.0**53:
            return (self.real[at] @ q.astype(np.float64)).astype(np.int64)
        return self.comps[at] @ q


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, comps = _unpack(row, row.dims)
                bucket = _Bucket(ids, comps)
                qids = np.frombuffer(row.q_ids, "<i8")
                queries = np.frombuffer(row.q_comps, "<i8").reshape(len(qids), row.dims)
                floors = np.full(len(qids), -np.inf) if row.floors is None else np.frombuffer(row.floors, "<f8")
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for qid, q, floor in zip(qids, queries, floors, strict=True):
                    at = bucket.candidates(q.astype(np.float64), float(np.sqrt((q.astype(np.float64) ** 2).sum())), float(floor))
                    at = at[bucket.ids[at] != qid]
                    scores = bucket.products(at, q)
                    top = _best(bucket.ids[at], scores, k)
                    top = top[scores[top] >= floor]
                    out.append((np.full(len(top), qid), bucket.ids[at][top], scores[top]))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 8192, query_block: int = 512, ratio: float = 1.1) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` largest integer products with other rows.

    Vectors are grouped by length (norms within a factor ``ratio``) into blocks, queries into blocks of their own.  A
    first pass over the longest blocks gives each query a floor, its k-th score so far; the second visits the blocks
    whose length can still reach a floor, and inside one prunes by length or by the coordinate list with the fewest vectors left
    at the local cosine threshold, then computes exact products.  Equal scores survive pruning, so ties go to the smaller id.

    Vectors of different dimension never meet.  Vectors that are null, without id, or with null or non-finite components
    take no part; a zero vector scores 0 with all; rows that share an id never match each other, and as queries with one id
    they share their ranks; fewer candidates give fewer rows; an empty table gives none.  Scores are 64-bit.
    """
    rows = cut_lineage(quantised(vectors))
    level = F.when(F.col("norm") > 0, F.floor(F.ln(F.greatest("norm", F.lit(1e-300))) / math.log(ratio))).otherwise(F.lit(-(2**31)))
    packed = cut_lineage(_blocks(rows, [F.col("dims").cast("bigint"), level.cast("bigint")], block, ["dims", "level"]))
    queries = cut_lineage(_blocks(rows.where(is_query), [F.col("dims").cast("bigint")], query_block, ["dims"]))
    queries = queries.select("dims", F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("comps").alias("q_comps"), F.col("longest").alias("q_longest"))

    longest = packed.groupBy("dims").agg(F.max_by(F.struct("level", "part"), F.struct("longest", "level", "part")).alias("at"))
    longest = longest.select("dims", "at.level", "at.part")
    first = packed.join(longest, ["dims", "level", "part"]).join(queries.withColumn("floors", F.lit(None).cast("binary")), "dims")
    cols = ["dims", "ids", "comps", "q_ids", "q_comps", "floors"]
    seen = _top(first.select(*cols).repartition("dims", F.xxhash64("q_ids")).mapInPandas(_search(k), SCORES), k)
    floor = cut_lineage(seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor")))

    one = rows.where(is_query).select("vec_id", "norm", "v", F.col("dims").cast("bigint").alias("dims"))
    one = one.join(floor, one["vec_id"] == floor["query_id"], "left").select("vec_id", "norm", "v", "dims", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    # A block is of use to a query if |q| times its longest vector reaches the floor; block sizes and lengths are one row a block.
    lengths = packed.select("dims", "level", "part", "longest")
    parts = one.groupBy("dims").agg(F.ceil(F.count("*") / query_block).cast("bigint").alias("parts"))
    one = one.join(parts, "dims").withColumn("q_part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        comps = np.stack(pdf["v"].to_numpy()).astype("<i8") if key[0] else np.zeros((len(pdf), 0), "<i8")
        reach = (pdf["floor"] / pdf["norm"].clip(lower=1e-300)).min()  # the shortest length that any query here needs
        return pd.DataFrame([[*key, pdf["vec_id"].to_numpy("<i8").tobytes(), comps.tobytes(), pdf["floor"].to_numpy("<f8").tobytes(), float(reach)]], columns=["dims", "q_part", "q_ids", "q_comps", "floors", "reach"])

    blocks = one.groupBy("dims", "q_part").applyInPandas(pack, "dims bigint, q_part bigint, q_ids binary, q_comps binary, floors binary, reach double")
    blocks = cut_lineage(blocks)
    wanted = blocks.select("dims", "q_part", "reach").join(lengths, "dims").where((F.col("reach") <= 0) | (F.col("longest") * (1 + _SLACK) >= F.col("reach")))
    work = wanted.select("dims", "level", "part", "q_part").join(packed.drop("longest"), ["dims", "level", "part"]).join(blocks.drop("reach"), ["dims", "q_part"])
    found = work.select(*cols, "level", "part", "q_part").repartition("dims", "level", "part", "q_part").select(*cols).mapInPandas(_search(k), SCORES)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
