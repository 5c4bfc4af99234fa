"""Composite scores, tiers, sweeps and dominance pairs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.functions import vocabulary as V
from tieline.operators.ordering import bucket_of, quantiles, split_points
from tieline.operators.sampling import seeded


def min_max(df: DataFrame, columns: Iterable[str], invert: Iterable[str] = (), log: Iterable[str] = ()) -> DataFrame:
    """Columns scaled to [0, 1]; constant columns become 0 (1 when inverted).

    The bounds are one-row scalar subqueries, so nothing is shuffled but two numbers a column.
    """
    columns, invert, log = list(columns), set(invert), set(log)
    for c in columns:
        if c in log:
            df = df.withColumn(c, F.log1p(c))
    bounds = df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns])
    out = {}
    for c in columns:
        lo, hi = bounds.select(f"{c}_lo").scalar(), bounds.select(f"{c}_hi").scalar()
        scaled = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
        out[c] = 1.0 - scaled if c in invert else scaled
    return df.withColumns(out)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(float(w)) * F.col(c)
    return total


def quantile_tiers(df: DataFrame, score: str, tiers: int = 5, out: str = "tier") -> DataFrame:
    """Right-closed quantile bins with interpolated edges and duplicate edges dropped; 0 is lowest."""
    probs = [i / tiers for i in range(0, tiers + 1)]
    q = quantiles(df, score, probs)
    inner = q.agg(*[F.max(f"q{i}").alias(f"e{i}") for i in range(tiers + 1)])
    edges = inner.select(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(tiers + 1)])).alias("e")).scalar()
    inside = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    above = F.size(F.filter(inside, lambda x: x < F.col(score)))
    return df.withColumn("_edges", edges).withColumn(out, above).drop("_edges")


def composite(
    features: DataFrame,
    weights: Mapping[str, float],
    invert: Iterable[str] = (),
    log: Iterable[str] = (),
    tiers: int = 5,
) -> DataFrame:
    """Adds ``composite_score`` (weighted sum of normalised features) and ``tier``."""
    features = features.persist()  # read for the bounds, the scores and the tier edges
    scaled = min_max(features, weights, invert, log)
    scored = scaled.select("node", weighted_sum(weights).alias("composite_score"))
    return quantile_tiers(features.join(scored, "node"), "composite_score", tiers)


def seniority(people: DataFrame, roles: DataFrame | None) -> DataFrame:
    """Role level when known, else five times directiveness, else 0."""
    if roles is None:
        return people.withColumn("seniority", F.coalesce(F.col("directiveness") * 5.0, F.lit(0.0)))
    return people.join(roles.select("name", "canonical_role_level"), "name", "left").withColumn(
        "seniority", F.coalesce(F.col("canonical_role_level").cast("double"), F.col("directiveness") * 5.0, F.lit(0.0))
    )


def blended(people: DataFrame, weight: float) -> DataFrame:
    """``composite_score_v3`` = composite + weight × normalised seniority, with five tiers."""
    part = min_max(people.select("name", F.col("seniority").alias("_s")), ["_s"])
    out = people.join(part, "name").withColumn("composite_score_v3", F.col("composite_score") + weight * F.col("_s")).drop("_s")
    return quantile_tiers(out, "composite_score_v3", out="tier_v3")


def leaders(people: DataFrame, metric: str, allowed: Sequence[str], tier: int | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` people by an allow-listed metric, optionally inside one tier."""
    if metric not in allowed:
        raise ValueError(f"unknown metric {metric!r}; allowed: {list(allowed)}")
    rows = people.where(F.col(metric).isNotNull())
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    return rows.orderBy(F.desc(metric), "name").limit(n).select("name", "title", "tier", F.col(metric).alias("score"))


def dominance_pairs(people: DataFrame) -> DataFrame:
    """All (superior, subordinate) pairs of different level.

    Every person is given the list of lower levels that exist, then joined on equal level: an
    equi-join instead of a nested loop over ``level >``.
    """
    levels = people.agg(F.sort_array(F.collect_set("level"))).scalar()
    sup = people.withColumn("_levels", levels).select(
        F.col("name").alias("superior"),
        F.col("level").alias("superior_level"),
        F.explode(F.filter("_levels", lambda x: x < F.col("level"))).alias("subordinate_level"),
    )
    sub = people.select(F.col("name").alias("subordinate"), F.col("level").alias("subordinate_level"))
    return sup.join(sub, "subordinate_level").where("superior <> subordinate").select(
        "superior", "subordinate", "superior_level", "subordinate_level"
    )


def score_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Status of each pair against (name, score): correct, wrong_order or missing; with the score gap."""
    s = scores.select("name", "score").where("score is not null")
    hi = s.select(F.col("name").alias("superior"), F.col("score").alias("superior_score"))
    lo = s.select(F.col("name").alias("subordinate"), F.col("score").alias("subordinate_score"))
    j = pairs.join(hi, "superior", "left").join(lo, "subordinate", "left")
    gap = F.col("superior_score") - F.col("subordinate_score")
    status = F.when(gap.isNull(), "missing").when(gap > 0, "correct").otherwise("wrong_order")
    return j.withColumns({"score_gap": gap, "status": status})


def pair_accuracy(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy over all pairs and coverage."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    n = F.count("*")
    return scored.groupBy(*keys).agg(
        is_("correct").alias("correct"),
        is_("wrong_order").alias("wrong_order"),
        is_("missing").alias("missing"),
        n.alias("total_pairs"),
        F.coalesce(F.try_divide(is_("correct"), n), F.lit(0.0)).alias("pair_accuracy"),
        F.coalesce(F.try_divide(is_("correct") + is_("wrong_order"), n), F.lit(0.0)).alias("coverage"),
    )


def count_pairs(people: DataFrame, scores: DataFrame) -> DataFrame:
    """(superior_level, subordinate_level, correct, wrong_order, missing, total_pairs) without a row per pair.

    What :func:`score_pairs` finds over :func:`dominance_pairs`, counted: each distinct (level, score) is sent once to
    every lower level and takes the number of smaller scores there from running totals inside score buckets.  Names
    are unique in ``people`` and ``scores``.
    """
    known = scores.select("name", F.col("score").cast("double").alias("score"))
    s = people.select("name", "level").join(known, "name", "left")
    levels = people.agg(F.sort_array(F.collect_set("level"))).scalar()
    lower = F.explode(F.filter("_levels", lambda x: x < F.col("level"))).alias("subordinate_level")
    counts = s.where("score is not null").groupBy("level", "score").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    asks = counts.withColumn("_levels", levels).select("score", F.col("level").alias("superior_level"), lower, F.col("n").alias("asks"), none.alias("holds"))
    nobody = F.when(F.lit(False), F.col("level")).alias("superior_level")
    holds = counts.select("score", nobody, F.col("level").alias("subordinate_level"), none.alias("asks"), F.col("n").alias("holds"))
    rows = asks.unionByName(holds).withColumn("_bucket", bucket_of(F.col("score"), split_points(s.where("score is not null"), "score")))
    earlier = Window.partitionBy("subordinate_level").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("subordinate_level", "_bucket").agg(F.sum("holds").alias("_h"))
    before = before.select("subordinate_level", "_bucket", F.coalesce(F.sum("_h").over(earlier), none).alias("_before"))
    # Those who ask stand before those who hold the same score, so only smaller scores are counted.
    inside = Window.partitionBy("subordinate_level", "_bucket").orderBy("score", "holds").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_running", F.coalesce(F.sum("holds").over(inside), none)).where("asks > 0").join(before, ["subordinate_level", "_bucket"])
    correct = rows.groupBy("superior_level", "subordinate_level").agg(F.sum(F.col("asks") * (F.col("_before") + F.col("_running"))).alias("correct"))
    sizes = s.groupBy("level").agg(F.count("*").alias("n"), F.count("score").alias("k"))
    high = sizes.withColumn("_levels", levels).select(F.col("level").alias("superior_level"), lower, F.col("n").alias("n1"), F.col("k").alias("k1"))
    low = sizes.select(F.col("level").alias("subordinate_level"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    both = high.join(low, "subordinate_level").join(correct, ["superior_level", "subordinate_level"], "left")
    total, scored, right = F.col("n1") * F.col("n2"), F.col("k1") * F.col("k2"), F.coalesce("correct", none)
    return both.select(
        "superior_level", "subordinate_level", right.alias("correct"), (scored - right).alias("wrong_order"), (total - scored).alias("missing"), total.alias("total_pairs")
    )


def accuracy_by_gap(scored: DataFrame) -> DataFrame:
    """Accuracy per (stage, gap) and per stage over all gaps (gap 0): one pass with grouping sets.

    ``scored``: stage, gap, correct (boolean).
    """
    return (
        scored.groupingSets([["stage", "gap"], ["stage"]], "stage", "gap")
        .agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
        .select("stage", F.when(F.col("_g") == 1, 0).otherwise(F.col("gap")).alias("gap"), "n", "accuracy")
    )


def weight_sweep(people: DataFrame, pairs: DataFrame, grid: Sequence[float] = V.SWEEP_GRID) -> DataFrame:
    """Accuracy of the blended score per weight over pairs with both scores; ``best`` marks the first maximum.

    The grid is exploded on the joined pairs, so people and pairs are joined once for all weights.
    """
    part = min_max(people.select("name", "composite_score", F.col("seniority").alias("_s")), ["_s"])
    hi = part.select(F.col("name").alias("superior"), F.col("composite_score").alias("_c1"), F.col("_s").alias("_s1"))
    lo = part.select(F.col("name").alias("subordinate"), F.col("composite_score").alias("_c2"), F.col("_s").alias("_s2"))
    j = pairs.join(hi, "superior").join(lo, "subordinate")
    rows = j.select("*", F.explode(F.array(*[F.lit(float(w)) for w in grid])).alias("weight"))
    win = F.col("_c1") + F.col("weight") * F.col("_s1") > F.col("_c2") + F.col("weight") * F.col("_s2")
    out = rows.groupBy("weight").agg(F.avg(win.cast("double")).alias("accuracy"), F.count("*").alias("n"))
    top = out.agg(F.max_by("weight", F.struct("accuracy", -F.col("weight")))).scalar()
    return out.withColumn("best", F.col("weight") == top)


def tune_by_fold(pairs: DataFrame, grid: Sequence[float] = V.SWEEP_GRID, folds: int = 5, seed: int = 42) -> DataFrame:
    """Per fold: the α with the best training accuracy of ``diff + α · deference > 0`` and its held-out accuracy.

    ``pairs``: a, b, diff, deference.  Folds come from a seeded hash of the pair, so no global
    order is needed.  One pass gives hits per (fold, α); training sums are totals minus the fold.
    """
    rows = pairs.where("diff is not null and deference is not null").select(
        F.pmod(F.conv(F.substring(seeded(seed, "a", "b"), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).alias("fold"),
        "diff",
        "deference",
        F.explode(F.array(*[F.lit(float(a)) for a in grid])).alias("alpha"),
    )
    hit = (F.col("diff") + F.col("alpha") * F.col("deference") > 0).cast("bigint")
    per = rows.groupBy("fold", "alpha").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    tot = per.groupBy("alpha").agg(F.sum("hits").alias("_h"), F.sum("n").alias("_n"))
    j = per.join(tot, "alpha").withColumns(
        {
            "train": F.try_divide(F.col("_h") - F.col("hits"), F.col("_n") - F.col("n")),
            "test": F.try_divide(F.col("hits"), F.col("n")),
            "n_train": F.col("_n") - F.col("n"),
        }
    )
    order = F.struct("train", -F.col("alpha"))
    return j.groupBy("fold").agg(
        F.max_by("alpha", order).alias("alpha"),
        F.max_by("test", order).alias("accuracy"),
        F.max("n_train").alias("n_train"),
        F.max("n").alias("n_test"),
    )


def ladder_scores(features: DataFrame, ladder: Mapping[str, Sequence[str]] = V.LADDER) -> DataFrame:
    """(stage, name, score): min-max scaled features summed over each cumulative rung."""
    names, sets = [], {}
    for stage, added in ladder.items():
        names += list(added)
        sets[stage] = list(names)
    have = [c for c in names if c in features.columns]
    filled = features.select("name", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in names])
    scaled = min_max(filled, names)
    rungs = F.array(
        *[F.struct(F.lit(s).alias("stage"), weighted_sum({c: 1.0 for c in cols}).alias("score")) for s, cols in sets.items()]
    )
    return scaled.select("name", F.inline(rungs))
