"""Pair, person and corpus rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tieline.operators.network import real_name
from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage

PAIR_ACTS = ("request", "commit", "deliver", "propose")


def pair_base(mail: DataFrame) -> DataFrame:
    """Dyadic sums and means before the reverse pair is joined (partial aggregation before the shuffle)."""
    acts = {f"_{a}": F.array_contains("speech_acts", a).cast("bigint") for a in PAIR_ACTS}
    rows = (
        mail.where(real_name(F.col("sender")))
        .withColumns(acts)
        .select("*", F.explode("recipients").alias("recipient"))
        .where(real_name(F.col("recipient")) & (F.col("sender") != F.col("recipient")))
    )
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    return rows.groupBy(F.col("sender").alias("sender_id"), F.col("recipient").alias("recipient_id")).agg(
        F.count("*").alias("n_emails"),
        *[F.sum(f"_{a}").alias(f"n_{a}_sent") for a in PAIR_ACTS],
        flag("decision_carrying").alias("n_decision"),
        flag("action_required").alias("n_action_required"),
        F.avg("sentiment").alias("mean_sentiment"),
        F.avg("body_word_count").alias("mean_body_words"),
        F.avg("reply_latency_hours").alias("mean_reply_latency_h"),
        F.min("date").alias("first_email_date"),
        F.max("date").alias("last_email_date"),
    )


def with_reverse(pairs: DataFrame) -> DataFrame:
    """Joins the opposite direction: length asymmetry and request/commit ratio (NULL without reverse or commits).

    Both directions hash to the same partition (on the unordered pair), so one shuffle of the
    rolled-up pairs serves the grouping; no self join is needed.
    """
    fwd = F.col("sender_id") < F.col("recipient_id")
    both = pairs.groupBy(
        F.least("sender_id", "recipient_id").alias("_a"), F.greatest("sender_id", "recipient_id").alias("_b")
    ).agg(
        F.max(F.when(fwd, F.struct(*pairs.columns))).alias("f"), F.max(F.when(~fwd, F.struct(*pairs.columns))).alias("r")
    )
    sides = F.array(F.struct(F.col("f").alias("x"), F.col("r").alias("o")), F.struct(F.col("r").alias("x"), F.col("f").alias("o")))
    rows = both.select(F.inline(sides)).where("x is not null")
    return rows.select(
        "x.*",
        (F.col("x.mean_body_words") - F.col("o.mean_body_words")).alias("length_asymmetry"),
        F.when(F.col("o.n_commit_sent") > 0, F.col("x.n_request_sent") / F.col("o.n_commit_sent")).alias("request_commit_ratio"),
    )


def pair_signals(mail: DataFrame) -> DataFrame:
    """The 18-column dyadic rollup."""
    out = with_reverse(pair_base(mail))
    return out.select(
        "sender_id", "recipient_id", "n_emails", F.col("n_emails").alias("n_to"), F.lit(0).cast("bigint").alias("n_cc"),
        *[f"n_{a}_sent" for a in PAIR_ACTS], "n_decision", "n_action_required", "mean_sentiment", "mean_body_words",
        "mean_reply_latency_h", "length_asymmetry", "request_commit_ratio", "first_email_date", "last_email_date",
    )


def top_items(df: DataFrame, key: str, items: str, k: int = 3, out: str = "top") -> DataFrame:
    """The ``k`` most frequent list items per key, as an ordered list (ties by name)."""
    counts = df.select(key, F.explode(items).alias("item")).groupBy(key, "item").agg(F.count("*").alias("n"))
    top = top_per_key(counts, [key], [F.desc("n"), F.col("item")], k)
    return top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias(out)
    )


def active_year(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Most frequent year per key, the smallest on ties; two aggregations, no ordering."""
    counts = df.where(F.col(date).isNotNull()).groupBy(key, F.year(date).alias("y")).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by("y", F.struct("n", -F.col("y"))).cast("bigint").alias("most_active_year"))


def person_rollup(mail: DataFrame) -> DataFrame:
    """Nineteen properties per sender.

    Needs the signal, text and thread columns on ``mail``.  Request, commit and deliver shares
    count repeated labels inside one mail.  The columns that four aggregations read are written once.
    """
    labels = lambda a: F.size(F.filter("speech_acts", lambda x: x == a)).alias(f"_{a}")
    rows = cut_lineage(
        mail.where(real_name(F.col("sender"))).select(
            "sender", "date", "topics", "entities", "decision_carrying", "action_required", "commitment_made", "sentiment", "body_word_count",
            "is_thread_initiator", "reply_latency_hours", "is_off_hours", "politeness_score", "hedge_count", F.size("recipients_emails").alias("_to"), *map(labels, ("request", "commit", "deliver")),
        )
    )
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    n = F.count("*")
    base = rows.groupBy("sender").agg(
        n.alias("n_emails_sent"),
        flag("decision_carrying").alias("n_decision_carrying_sent"),
        flag("action_required").alias("n_action_required_sent"),
        flag("commitment_made").alias("n_commitment_made_sent"),
        (F.sum("_request") / n).alias("pct_request_sent"),
        (F.sum("_commit") / n).alias("pct_commit_sent"),
        (F.sum("_deliver") / n).alias("pct_deliver_sent"),
        share("decision_carrying").alias("pct_decision_carrying"),
        F.avg("sentiment").alias("mean_sentiment_sent"),
        F.avg("body_word_count").alias("mean_body_words"),
        F.avg("_to").alias("mean_to_count"),
        share("is_thread_initiator").alias("pct_thread_initiator"),
        F.avg("reply_latency_hours").alias("mean_reply_latency_received_hours"),
        share("is_off_hours").alias("pct_off_hours"),
        F.avg("politeness_score").alias("politeness_baseline"),
        (F.sum("hedge_count") / n).alias("hedge_rate"),
    )
    return (
        base.join(top_items(rows, "sender", "topics", 3, "top3_topics"), "sender", "left")
        .join(top_items(rows, "sender", "entities", 3, "top3_entities"), "sender", "left")
        .join(active_year(rows, "sender"), "sender", "left")
    )


def corpus_stats(mail: DataFrame, domain: Column, internal: str) -> DataFrame:
    """One row of totals: dates, empty fields, sender domains, internal and external mail.

    The distinct domain count rides on a pre-aggregation by domain, so one pass is enough.
    """
    by_domain = mail.groupBy(domain.alias("_domain")).agg(
        F.count("*").alias("n"),
        F.count("date").alias("valid"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count_if(F.trim(F.coalesce("subject", F.lit(""))) == "").alias("no_subject"),
        F.count_if(F.coalesce("body_chars", F.lit(0)) == 0).alias("no_body"),
    )
    inside = F.coalesce(F.col("_domain") == internal, F.lit(False))
    return by_domain.agg(
        F.sum("n").alias("emails_loaded"),
        F.sum("valid").alias("valid_dates"),
        (F.sum("n") - F.sum("valid")).alias("invalid_dates"),
        F.min("first").alias("date_min"),
        F.max("last").alias("date_max"),
        F.sum("no_subject").alias("empty_subjects"),
        F.sum("no_body").alias("empty_bodies"),
        F.count("_domain").alias("unique_sender_domains"),
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("internal_emails"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("external_emails"),
    )


def value_counts(df: DataFrame, col: Column | str, out: str, k: int | None = None) -> DataFrame:
    """Counts per value, heaviest first (ties by value); the first ``k`` when given."""
    c = F.col(col) if isinstance(col, str) else col
    counts = df.select(c.alias(out)).where(F.col(out).isNotNull()).groupBy(out).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), out).limit(k) if k else counts


def eligible_pairs(edges: DataFrame, minimum: int) -> DataFrame:
    """Unordered pairs whose two-way weight reaches the minimum."""
    return (
        edges.groupBy(F.least("src", "dst").alias("person_a"), F.greatest("src", "dst").alias("person_b"))
        .agg(F.sum("weight").alias("total"))
        .where(F.col("total") >= minimum)
    )


def fill_with_median(features: DataFrame, columns: Sequence[str], fallback: float = 1.0) -> DataFrame:
    """NULLs of each column to its exact median (``fallback`` when the column is all NULL)."""
    from tieline.operators.ordering import quantiles

    for c in columns:
        med = quantiles(features, c, [0.5]).agg(F.max("q0")).scalar()
        features = features.withColumn(c, F.coalesce(F.col(c), med, F.lit(fallback)))
    return features
