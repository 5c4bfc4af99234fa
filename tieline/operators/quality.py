"""Coverage, diversity and monotonicity checks over enrichment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.operators.ordering import quantiles


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, fill_rate): share of rows where the field is neither NULL nor empty."""
    full = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    row = df.agg(*[(full(c) / F.count("*")).alias(c) for c in fields])
    return row.unpivot([], list(fields), "field", "fill_rate")


def colour(value: Column, green: float, yellow: float | None = None, lower_is_better: bool = False) -> Column:
    """Traffic light of a metric against its thresholds."""
    ok = (lambda lim: value <= lim) if lower_is_better else (lambda lim: value >= lim)
    out = F.when(ok(green), "green")
    if yellow is not None:
        out = out.when(ok(yellow), "yellow")
    return out.otherwise("red")


def verdict(metrics: DataFrame, colour_col: str = "colour") -> DataFrame:
    """One row: counts of lights and the overall verdict (go, caution, review)."""
    n = metrics.agg(*[F.count_if(F.col(colour_col) == c).alias(c) for c in ("green", "yellow", "red")])
    return n.withColumn("verdict", F.when(F.col("red") > 0, "review").when(F.col("yellow") > 0, "caution").otherwise("go"))


def enrichment_quality(df: DataFrame, text: str, target: int | None = None) -> DataFrame:
    """Coverage and diversity of a narrative column (one row).

    Needs ``confidence`` and ``style``; a row is heuristic when its confidence is 1 and its style
    text is the template.  Distinct texts are counted by digest, the median length exactly.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    heur = (F.col("confidence") == 1) & F.col("style").startswith("Communicates in a")
    rows = df.withColumns({"_body": body, "_len": F.when(body != "", F.length(body)), "_h": F.coalesce(heur, F.lit(False))})
    med = quantiles(rows, "_len", [0.5]).agg(F.max("q0")).scalar()
    base = rows.agg(
        F.count("*").alias("rows"),
        (100.0 * F.count("_len") / F.count("*")).alias("pct_populated"),
        (100.0 * F.count_if("_h") / F.count("*")).alias("pct_heuristic"),
        (100.0 * F.count_distinct(F.when(F.col("_body") != "", F.sha2("_body", 256))) / F.count("_len")).alias("pct_unique"),
        F.avg("_len").alias("mean_length"),
        F.stddev_samp("_len").alias("stdev_length"),
    )
    return base.withColumn("median_length", med)


def monotone(df: DataFrame, key: str, value: str) -> DataFrame:
    """Group means in key order and whether they never fall.

    The window runs over one row per key value, not over the table.
    """
    means = df.groupBy(key).agg(F.round(F.avg(value)).alias("mean"))
    step = means.withColumn("_prev", F.lag("mean").over(Window.orderBy(key)))
    return step.agg(
        F.count("*").alias("groups"), F.bool_and(F.coalesce(F.col("_prev") <= F.col("mean"), F.lit(True))).alias("monotone")
    )


def known_entity_hits(df: DataFrame, variants: DataFrame, keywords: DataFrame, name: str, text: str) -> DataFrame:
    """Expected entities found with one of their keywords in the text.

    ``variants``: variant → canonical (lower-case variants).  ``keywords``: canonical, words.
    """
    named = df.join(variants, F.lower(F.trim(F.col(name))) == F.col("variant"), "left").select(
        F.coalesce("canonical", F.col(name)).alias("canonical"), F.lower(F.col(text)).alias("_text")
    )
    hit = F.exists("words", lambda w: F.col("_text").contains(w))
    found = named.join(keywords, "canonical").groupBy("canonical").agg(F.bool_or(hit).alias("hit"))
    total = keywords.agg(F.count("*")).scalar()
    return found.agg(F.count_if("hit").alias("hits"), F.count("*").alias("present")).withColumn("total", total)
