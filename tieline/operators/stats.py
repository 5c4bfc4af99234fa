"""Agreement measures, rank correlation and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tieline.operators.ordering import average_rank, quantiles, value_ranks
from tieline.operators.sampling import seeded


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman's ρ with averaged ties per key; 0 below three rows or for a constant side."""
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    rx = value_ranks(rows, x, keys).select(*keys, x, average_rank().alias("_rx"))
    ry = value_ranks(rows, y, keys).select(*keys, y, average_rank().alias("_ry"))
    j = rows.join(rx, [*keys, x]).join(ry, [*keys, y])
    rho = F.when((F.stddev("_rx") > 0) & (F.stddev("_ry") > 0), F.corr("_rx", "_ry"))
    return j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("rho")
    )


def spearman_ordinal(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """ρ over ordinal ranks, equal values ranked in the order of ``tie`` (a unique column)."""
    def ranks(col: str, out: str) -> DataFrame:
        base = value_ranks(df, col).select(col, "n_below")
        from pyspark.sql import Window

        w = Window.partitionBy(col).orderBy(tie)
        return df.select(tie, col).join(base, col).select(tie, (F.col("n_below") + F.row_number().over(w) - 1).alias(out))

    j = ranks(x, "_rx").join(ranks(y, "_ry"), tie)
    return j.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_rx", "_ry")).alias("rho"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean of entropies); 0 below two rows, 1 for two constants."""
    c = contingency(df, a, b)
    total = c.agg(F.sum("n")).scalar()
    plogp = lambda n: -(n / total) * F.log(n / total)
    h = lambda side: c.groupBy(side).agg(F.sum("n").alias("m")).agg(F.sum(plogp(F.col("m")))).scalar()
    joint = c.agg(F.sum(plogp(F.col("n"))).alias("hab"), F.sum("n").alias("rows"))
    mi = h("a") + h("b") - F.col("hab")
    mean = (h("a") + h("b")) / 2
    return joint.select(
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.coalesce("rows", F.lit(0)) < 2, 0.0).when(mean < 1e-12, 1.0).otherwise(mi / mean).alias("nmi"),
    )


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index."""
    c = contingency(df, a, b)
    two = lambda n: n * (n - 1) / 2.0
    side = lambda s: c.groupBy(s).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m")))).scalar()
    cells = c.agg(F.sum(two(F.col("n"))).alias("same"), two(F.sum("n")).alias("pairs"))
    expected = side("a") * side("b") / F.col("pairs")
    top = (side("a") + side("b")) / 2
    return cells.select(F.when(top == expected, 1.0).otherwise((F.col("same") - expected) / (top - expected)).alias("ari"))


def purity(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    c = contingency(df, truth, cluster)
    return c.groupBy("b").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))


def kappa(df: DataFrame, gold: str, pred: str, tags: Sequence[str]) -> DataFrame:
    """Cohen's κ per tag over label lists, 0 when a side is constant; plus a ``macro`` row.

    One pass: each row yields one (tag, gold, pred) triple per tag, combined before the shuffle.
    """
    triples = F.array(
        *[
            F.struct(F.lit(t).alias("tag"), F.array_contains(gold, t).cast("bigint").alias("g"), F.array_contains(pred, t).cast("bigint").alias("p"))
            for t in tags
        ]
    )
    s = df.select(F.inline(triples)).groupBy("tag").agg(
        F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("p")).alias("b")
    )
    n = F.col("n")
    agree = (n - F.col("g") - F.col("p") + 2 * F.col("b")) / n
    chance = (F.col("g") * F.col("p") + (n - F.col("g")) * (n - F.col("p"))) / (n * n)
    flat = F.col("g").isin(0) | F.col("p").isin(0) | (F.col("g") == n) | (F.col("p") == n)
    per = s.select("tag", F.when(flat, 0.0).otherwise((agree - chance) / (1 - chance)).alias("kappa"))
    return per.unionByName(per.agg(F.lit("macro").alias("tag"), F.avg("kappa").alias("kappa")))


#: Modulus of the seeded draws; products of two remainders fit a long.
PRIME = (1 << 31) - 1


def _poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform number by its distribution function, to the last bit of a double."""
    acc, p, out = 0.0, math.exp(-1.0), None
    for k in range(0, 18):
        acc += p
        out = F.when(u < acc, k) if out is None else out.when(u < acc, k)
        p /= k + 1
    return out.otherwise(18)


def _drawn(seed: int, name: str, replicate: int) -> int:
    return int(hashlib.md5(f"{seed}|{name}|{replicate}".encode()).hexdigest()[:8], 16) % PRIME


def resample_means(df: DataFrame, value: str, key: str, replicates: int = 1000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by…, replicate, mean): bootstrap means with seeded Poisson(1) weights.

    A weight depends only on (seed, replicate, row key): the result does not depend on how the
    data is partitioned, and re-run tasks repeat it.  A row key is hashed once; each replicate is a random
    linear map of that hash modulo a prime, so a draw costs one product.  The replicates of a row are summed in the
    map task, so only ``replicates`` rows per task and group travel.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_h", F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("bigint") % PRIME)
    maps = ",".join(f"struct({r},{_drawn(seed, 'a', r)}L,{_drawn(seed, 'b', r)}L)" for r in range(replicates))
    reps = rows.select("*", F.inline(F.expr(f"array({maps})")).alias("replicate", "_a", "_b"))
    u = ((F.col("_h") * F.col("_a") + F.col("_b")) % PRIME) / float(PRIME)
    w = reps.withColumn("_w", _poisson_one(u))
    s = w.groupBy(*by, "replicate").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    return s.where("_n > 0").select(*by, "replicate", (F.col("_s") / F.col("_n")).alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, key: str, replicates: int = 1000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """2.5, 50 and 97.5 percentiles of the resampled means."""
    q = quantiles(resample_means(df, value, key, replicates, seed, by), "mean", [0.025, 0.5, 0.975], list(by))
    return q.select(*by, F.col("q0").alias("low"), F.col("q1").alias("median"), F.col("q2").alias("high"))


def paired_bootstrap(
    df: DataFrame, a: str, b: str, key: str, replicates: int = 1000, seed: int = 42, mid_p: bool = False, alpha: float = 0.05
) -> DataFrame:
    """Mean of ``a − b`` with interval and one-sided p for a > b.

    ``mid_p=False``: percentile interval, p = share of replicates ≤ 0.  ``mid_p=True``: interval at
    the sorted positions of the replicates, p = negatives plus half the zeros.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    means = resample_means(d, "_d", key, replicates, seed)
    observed = d.agg(F.avg("_d")).scalar()
    below, zero = F.count_if(F.col("mean") < 0), F.count_if(F.col("mean") == 0)
    p = (below + 0.5 * zero) / F.count("*") if mid_p else (below + zero) / F.count("*")
    tests = means.agg(p.alias("p"))
    if mid_p:
        # One number per replicate, so a sorted list of them is bounded by ``replicates``.
        lo, hi = int(alpha / 2 * replicates), max(0, int((1 - alpha / 2) * replicates) - 1)
        ordered = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))
        q = ordered.select(F.get("m", F.lit(lo)).alias("low"), F.get("m", F.lit(hi)).alias("high"))
    else:
        q = quantiles(means, "mean", [alpha / 2, 1 - alpha / 2]).select(F.col("q0").alias("low"), F.col("q1").alias("high"))
    return tests.select(
        observed.alias("mean_delta"), q.select("low").scalar().alias("low"), q.select("high").scalar().alias("high"), "p"
    )


def ranking_metrics(ranked: DataFrame, group: str, query: str = "qid", depths: Sequence[int] = (5, 10), ndcg_at: int = 5) -> DataFrame:
    """MRR, recall@k and NDCG@k per group.  ``ranked``: group, query, rank (from 1), relevant."""
    rel = F.col("relevant").cast("bigint")
    gain = F.when((F.col("rank") <= ndcg_at) & F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = ranked.groupBy(group, query).agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(rel).alias("n_rel"),
        *[F.sum(F.when(F.col("rank") <= k, rel).otherwise(0)).alias(f"h{k}") for k in depths],
        F.sum(gain).alias("dcg"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_rel"), F.lit(ndcg_at)).cast("int"))),
        F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + F.lit(1)),
    )
    some = F.col("n_rel") > 0
    return per.groupBy(group).agg(
        F.count("*").alias("n_queries"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        *[F.avg(F.when(some, F.col(f"h{k}") / F.col("n_rel")).otherwise(0.0)).alias(f"recall_at_{k}") for k in depths],
        F.avg(F.when(some, F.col("dcg") / ideal).otherwise(0.0)).alias(f"ndcg_at_{ndcg_at}"),
    )
