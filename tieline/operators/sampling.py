"""Deterministic samples: strata, buckets, representatives, hold-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import text as X
from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage


def seeded(seed: int, *keys: str) -> Column:
    """Hexadecimal digest of the seed and the keys: a draw that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def random_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in an order set by a seeded hash of the key, so repeats and re-run tasks agree."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def stratified(df: DataFrame, by: Sequence[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to ``max(1, n // strata)`` rows per stratum in seeded-hash order, ``n`` in total."""
    strata = df.select(*by).distinct().count()
    if not strata:
        return df
    picked = top_per_key(df, list(by), [seeded(seed, key), F.col(key)], max(1, n // strata), "_rank")
    return picked.orderBy("_rank", *by).limit(n).drop("_rank")


def bucketed(mail: DataFrame, topics: DataFrame, n_decision: int = 5, n_topic: int = 5, n_longest: int = 5) -> DataFrame:
    """Per sender: longest decision mails, then longest unseen per top topic, then longest unseen: (sender, email_id, bucket).

    ``topics``: sender, topics (ordered list of at most three).  Earlier buckets win.  Candidate
    lists are cut to the few rows that can still matter: a bucket needs its quota plus what
    earlier buckets may have taken.
    """
    order = [F.desc("body_word_count"), F.col("email_id")]
    base = mail.select("sender", "email_id", "body_word_count", "decision_carrying", F.col("topics").alias("_t"))
    taken = top_per_key(base.where("decision_carrying"), ["sender"], order, n_decision).select(
        "sender", "email_id", F.lit("decision").alias("bucket")
    )
    width = 3
    # Mails meet their sender's short list: all that follows is dealt by sender.
    listed = base.join(topics.select("sender", F.col("topics").alias("_top")), "sender")
    on_topic = listed.select("sender", "email_id", "body_word_count", "_t", F.posexplode("_top").alias("_i", "topic")).where(F.array_contains("_t", F.col("topic")))
    pool = top_per_key(on_topic.drop("_t"), ["sender", "_i"], order, n_decision + width * n_topic, "_r")
    # Each step reads the rows taken so far twice; a written table keeps that from multiplying.
    taken, pool = cut_lineage(taken), cut_lineage(pool)
    for i in range(width):
        part = pool.where(F.col("_i") == i).join(taken, ["sender", "email_id"], "left_anti")
        more = top_per_key(part, ["sender"], order, n_topic).select("sender", "email_id", F.lit(f"topic_{i + 1}").alias("bucket"))
        taken = cut_lineage(taken.unionByName(more))
    rest = top_per_key(base, ["sender"], order, n_decision + width * n_topic + n_longest, "_r").join(taken, ["sender", "email_id"], "left_anti")
    return taken.unionByName(top_per_key(rest, ["sender"], order, n_longest).select("sender", "email_id", F.lit("longest").alias("bucket")))


def representatives_per_person(mail: DataFrame, out: int = 8, into: int = 8, starts: int = 4, cap: int = 20) -> DataFrame:
    """Per person: longest sent, longest received, longest thread starts; duplicates once, at most ``cap``.

    (name, email_id, part)
    """
    cols = ["email_id", "body_chars"]
    order = [F.desc("body_chars"), F.col("email_id")]
    sent = mail.select(F.col("sender").alias("name"), "subject", *cols)
    got = mail.select(F.explode(F.array_distinct("recipients")).alias("name"), *cols)
    low = F.lower("subject")
    fresh = sent.where(~(low.startswith("re:") | low.startswith("fw:") | low.startswith("fwd:")))
    pick = lambda df, k, tag: top_per_key(df, ["name"], order, k).select("name", "email_id", F.lit(tag).alias("part"), "rank")
    union = pick(sent, out, 0).unionByName(pick(got, into, 1)).unionByName(pick(fresh, starts, 2))
    first = union.groupBy("name", "email_id").agg(F.min(F.struct("part", "rank")).alias("_p"))
    kept = top_per_key(first, ["name"], [F.col("_p")], cap)
    return kept.select("name", "email_id", F.col("_p.part").alias("part"))


def representatives_per_pair(mail: DataFrame, k: int = 5, minimum: int = 5) -> DataFrame:
    """Per unordered pair with enough mails: the longest of each direction (k//2 and k − k//2)."""
    rows = mail.select("sender", "email_id", "body_chars", F.explode(F.array_distinct("recipients")).alias("recipient")).where(
        "sender <> recipient"
    )
    rows = rows.withColumns(
        {"person_a": F.least("sender", "recipient"), "person_b": F.greatest("sender", "recipient"), "forward": F.col("sender") < F.col("recipient")}
    )
    enough = rows.groupBy("person_a", "person_b").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    half = max(1, k // 2)
    top = top_per_key(rows, ["person_a", "person_b", "forward"], [F.desc("body_chars"), F.col("email_id")], max(half, k - half))
    quota = F.when(F.col("forward"), half).otherwise(k - half)
    return top.where(F.col("rank") <= quota).join(enough, ["person_a", "person_b"], "left_semi").select(
        "person_a", "person_b", "sender", "email_id", "rank"
    )


def hold_outs(mail: DataFrame, body: Column, n: int = 5) -> DataFrame:
    """Latest ``n`` mails per sender with 50 words or more and at most 30 % quoted lines."""
    ok = mail.withColumns({"word_count": X.blank_word_count(body), "quoted": X.quoted_fraction(body)}).where(
        "word_count >= 50 and quoted <= 0.30"
    )
    return top_per_key(ok.select("sender", "email_id", "date", "word_count", "quoted"), ["sender"], [F.desc("date"), F.col("email_id")], n)


def persona_picks(people: DataFrame, n: int = 5) -> DataFrame:
    """Per tier band the ``n`` busiest people, widened when their formality spans less than 3.

    ``people``: name, tier, formality, volume.  The busiest outsider with formality ≥ 4 and the one
    with ≤ 2 then replace the least busy picks.
    """
    band = F.when(F.col("tier").isin(1, 2), "senior").when(F.col("tier").isin(3, 4), "mid").when(F.col("tier") >= 5, "ic")
    rows = people.withColumn("band", band).where("band is not null")
    order = [F.desc("volume"), F.col("name")]
    top = top_per_key(rows, ["band"], order, n)
    span = top.groupBy("band").agg((F.max("formality") - F.min("formality")).alias("_span"), F.count("*").alias("_n"))
    outside = rows.join(top.select("name"), "name", "left_anti")
    high = top_per_key(outside.where("formality >= 4"), ["band"], order, 1).withColumn("_side", F.lit(0))
    low = top_per_key(outside.where("formality <= 2"), ["band"], order, 1).withColumn("_side", F.lit(1))
    swaps = high.unionByName(low).join(span.where("_n >= 2 and _span < 3"), "band")
    quota = swaps.groupBy("band").agg(F.least(F.count("*"), F.max("_n") - 1).alias("_drop"))
    kept = top.join(quota, "band", "left").join(span.select("band", "_n"), "band").where(
        F.col("rank") <= F.col("_n") - F.coalesce("_drop", F.lit(0))
    )
    added = top_per_key(swaps.drop("rank"), ["band"], [F.col("_side")], 2, "_k").join(quota, "band").where("_k <= _drop")
    cols = ["band", "name", "tier", "formality", "volume"]
    return kept.select(*cols).unionByName(added.select(*cols))
