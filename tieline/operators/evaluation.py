"""Tables over run logs, verdicts and question results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import text as X
from tieline.functions import vocabulary as V
from tieline.operators.ordering import quantiles


def subset_stats(rows: DataFrame) -> DataFrame:
    """Per overlapping subset and arm: n, mean F1, latency and fallback rate.  One row counts in each subset it fits."""
    tags = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(F.col("qtype").isin("relational", "temporal"), "relational_temporal"),
            F.col("qtype"),
            F.col("role"),
        )
    )
    return rows.select("condition", "f1", "latency_ms", "used_fallback", F.explode(tags).alias("subset")).groupBy("subset", "condition").agg(
        F.count("*").alias("n"),
        F.avg("f1").alias("mean_f1"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.avg(F.col("used_fallback").cast("double")).alias("fallback_rate"),
    )


def arm_pivot(scores: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str], value: str) -> DataFrame:
    """Mean per arm side by side, with the difference of the first two arms."""
    out = scores.groupBy(*by).pivot(arm, list(arms)).agg(F.avg(value))
    return out.withColumn("delta", F.col(arms[0]) - F.col(arms[1])) if len(arms) >= 2 else out


def headline(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    calls, ms = F.coalesce("n_tool_calls", F.lit(0)), F.coalesce("wall_time_ms", F.lit(0))
    ok = F.coalesce("passed", F.lit(False)).cast("bigint")
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(ok).alias("n_passed"), F.avg(ok).alias("pass_rate"), F.sum(calls).alias("total_calls"),
        F.avg(calls).alias("mean_calls"), F.avg(ms).alias("mean_ms"), F.sum(ms).alias("total_ms"),
    )


def category_rates(runs: DataFrame, thresholds: Mapping[str, float] = V.PASS_THRESHOLDS) -> DataFrame:
    """Pass rate per category against its threshold (0 when not listed), with median and longest time."""
    ok = F.coalesce("passed", F.lit(False)).cast("double")
    rates = runs.groupBy("category").agg(
        F.count("*").alias("n"), F.sum(ok).cast("bigint").alias("n_passed"), F.avg(ok).alias("pass_rate"), F.max("wall_time_ms").alias("max_ms")
    )
    mid = quantiles(runs, "wall_time_ms", [0.5], ["category"]).select("category", F.col("q0").alias("p50_ms"))
    out = rates.join(mid, "category", "left").withColumn("threshold", F.coalesce(X.ordinal_map(F.col("category"), dict(thresholds)), F.lit(0.0)))
    return out.withColumn("meets_threshold", F.col("pass_rate") >= F.col("threshold"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls and error share per tool.  ``calls``: tool, error."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.coalesce("error", F.lit("")) != "") / F.count("*"), 4).alias("error_rate")
    )


def compare_runs(base: DataFrame, candidate: DataFrame, key: str = "question_id") -> DataFrame:
    """Full outer comparison of two runs: marks ✓ ✗ - and the change."""
    j = base.select(key, F.col("passed").alias("_b"), F.lit(True).alias("_hb")).join(
        candidate.select(key, F.col("passed").alias("_c"), F.lit(True).alias("_hc")), key, "full"
    )
    mark = lambda have, ok: F.when(F.col(have).isNull(), "-").when(F.coalesce(F.col(ok), F.lit(False)), "✓").otherwise("✗")
    both = F.col("_hb").isNotNull() & F.col("_hc").isNotNull()
    b, c = F.coalesce("_b", F.lit(False)), F.coalesce("_c", F.lit(False))
    change = F.when(both & b & ~c, "regression").when(both & ~b & c, "improvement").otherwise("")
    return j.select(key, mark("_hb", "_b").alias("base"), mark("_hc", "_c").alias("candidate"), change.alias("change"))


def cascade_metrics(runs: DataFrame) -> DataFrame:
    """Per question routing hit, dispatch precision, category coverage and minimum met.

    ``runs``: question_id, passed, initial_pick, dispatches array<struct<src,dst>>, expected_initial
    array<string>, expected_targets map<string,array<string>>, min_categories.
    """
    slugs = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: X.name_slug(x))
    sent = F.filter("dispatches", lambda e: (e["src"] != "user") & (e["dst"] != "user"))
    uniq = F.array_distinct(F.transform(sent, lambda e: X.name_slug(e["dst"])))
    df = runs.withColumns({"_to": uniq, "_start": slugs(F.col("expected_initial"))})
    wanted = F.flatten(F.transform(F.map_values("expected_targets"), slugs))
    covered = F.filter(F.map_values("expected_targets"), lambda s: F.arrays_overlap(slugs(s), F.col("_to")))
    n_cat = F.size(F.map_keys("expected_targets"))
    return df.select(
        "question_id",
        "passed",
        F.when(F.size("_start") > 0, F.array_contains("_start", X.name_slug(F.coalesce("initial_pick", F.lit(""))))).alias("routing_hit"),
        F.when(F.size("_to") > 0, F.size(F.array_intersect("_to", wanted)) / F.size("_to")).alias("dispatch_precision"),
        F.when(n_cat > 0, F.size(covered) / n_cat).alias("dispatch_coverage"),
        F.when(n_cat > 0, F.size(covered) >= F.coalesce("min_categories", F.lit(1))).alias("min_categories_met"),
        F.size("_to").alias("n_dispatches"),
    )


def cascade_summary(scored: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return scored.agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce("passed", F.lit(False)).cast("double")).alias("answer_pass_rate"),
        mean("routing_hit").alias("routing_accuracy"),
        mean("dispatch_precision").alias("mean_dispatch_precision"),
        mean("dispatch_coverage").alias("mean_dispatch_coverage"),
        mean("min_categories_met").alias("min_categories_met_rate"),
        F.count("routing_hit").alias("n_with_routing"),
        F.count_if(F.col("n_dispatches") > 0).alias("n_with_dispatches"),
    )


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """(scenario, condition, dimension, score) from verdicts, plus mean and flag-count rows."""
    key = [F.col("scenario_name").alias("scenario"), "condition"]
    dims = verdicts.select(*key, F.explode("scores").alias("dimension", "_s")).select(
        "scenario", "condition", "dimension", F.col("_s.score").cast("double").alias("score")
    )
    mean = verdicts.select(*key, F.lit("_mean").alias("dimension"), F.round("mean_score", 3).alias("score"))
    flags = verdicts.select(*key, F.lit("_turn_flag_count").alias("dimension"), F.size(F.coalesce("turn_flags", F.array())).cast("double").alias("score"))
    return dims.unionByName(mean).unionByName(flags)


def attribution(hold_outs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of hold-outs where the persona beats the control, and of stylometry matches.

    A pick counts for the persona, or for the real text when the persona is closer in bigrams.
    ``hold_outs``: picked, persona_closer, signoff_match.
    """
    won = (F.col("picked") == "persona") | ((F.col("picked") == "actual") & F.col("persona_closer"))
    share = lambda c: F.avg(c.cast("double"))
    return hold_outs.groupBy(*by).agg(
        F.count("*").alias("n"), share(won).alias("attribution_rate"), share(F.col("persona_closer")).alias("closer_rate"),
        share(F.col("signoff_match")).alias("signoff_rate"),
    )


def best_variant(variants: DataFrame, variant: str, rate: str, total: str) -> DataFrame:
    """The variant with the best (rate, total)."""
    return variants.agg(F.max_by(F.struct(variant, rate, total), F.struct(rate, total)).alias("w")).select("w.*")


def gate(metric: Column, minimum: float, low: Column | None = None) -> Column:
    """PASS when the metric reaches its minimum and, where given, the interval's lower end is above 0."""
    ok = metric >= minimum
    return F.when(ok & (low > 0) if low is not None else ok, "PASS").otherwise("FAIL")
