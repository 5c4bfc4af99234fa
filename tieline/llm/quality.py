"""Operator 5: quality rules by a hashed n-gram log-likelihood ratio, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import with_whole_row

WORD = r"[^\x20\x09-\x0D]+"


def features(low: Column, buckets: int) -> tuple[Column, Column]:
    """Hash buckets of the words in an array of lower-cased words, and of the pairs of neighbours."""
    single = F.transform(low, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    double = F.transform(low, lambda w, i: F.pmod(F.xxhash64(w, F.get(low, i + 1)), F.lit(buckets)).cast("int"))
    return single, F.slice(double, 1, F.greatest(F.size(low) - 1, F.lit(0)))


def _featured(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` (with a word array ``words``) and its n-gram buckets ``grams``."""
    return df.withColumn("low", F.transform("words", lambda w: F.lower(w))).withColumn("grams", F.concat(*features(F.col("low"), buckets))).drop("low")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, trusted_rows: int = 50_000) -> list[float]:
    """Log ratio of target to corpus probability for each bucket.

    The corpus multinomial counts every n-gram of every document.  The target multinomial counts those of documents
    labelled ``quality = 1``: all of them, or, beyond ``trusted_rows``, the ``trusted_rows`` with the smallest id hash.  Both get
    one added count a bucket.  The driver sees two counts a bucket.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("trusted")).distinct()
    trusted = trusted.orderBy(F.xxhash64("trusted"), "trusted").limit(trusted_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    # At most `trusted_rows` ids of eight bytes.
    rows = rows.join(F.broadcast(trusted), rows["doc_id"] == trusted["trusted"], "left")
    grams = _featured(rows, buckets).select(F.col("trusted").isNotNull().alias("target"), F.explode_outer("grams").alias("bucket"))
    # The outer form keeps Spark from repeating the n-gram expressions in a filter below.
    counts = grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("corpus"), F.count_if("target").alias("target")).collect()
    corpus, target = [1] * buckets, [1] * buckets
    for r in counts:
        corpus[r["bucket"]] += r["corpus"]
        target[r["bucket"]] += r["target"]
    n, m = sum(corpus), sum(target)
    if m == buckets:
        return [0.0] * buckets
    return [math.log(t / m) - math.log(c / n) for t, c in zip(target, corpus, strict=True)]


def measure(df: DataFrame, text: str, model: list[float], threshold: float) -> DataFrame:
    """``df`` with the rule columns in a struct ``rules``: base counts, ``base_failed``, ``score`` and ``kept``."""
    buckets = len(model)
    ratio = F.expr("array(" + ",".join(f"{x!r}D" for x in model) + ")")
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", t).withColumn("words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n", F.size("words").cast("bigint"))
    five = F.transform(
        F.when(F.col("n") >= 5, F.sequence(F.lit(0), F.size("words") - 5)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(5)]),
    )
    df = df.withColumn("five", five)
    order = F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("order", F.when(F.size(F.array_distinct("five")) < F.size("five"), order))
    same = lambda p, k: F.coalesce(F.get(F.col("order"), k)["h"] == p["h"], F.lit(False))
    again = F.filter("order", lambda p, k: ((k > 0) & same(p, F.greatest(k - 1, F.lit(0)))) | same(p, k + 1))
    df = df.withColumn("starts", F.sort_array(F.transform(again, lambda p: p["i"])))
    gaps = F.transform("starts", lambda s, k: F.least(F.lit(5), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(5))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    df = _featured(df.withColumn("repeated", repeated).drop("five", "order", "starts"), buckets)
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(ratio, b))
    score = total / F.greatest(F.size("grams"), F.lit(1))
    failed = (F.col("n") < 10) | (100 * F.col("repeated") > 20 * F.col("n"))
    chars = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    df = df.withColumn("score", score)
    rules = F.struct(
        F.col("n").alias("n_words"),
        chars.alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("repeated").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("score").alias("score"),
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
    # One row each: filters on the rules stay above this step and are not rewritten into the array expressions below.
    return df.drop("rules").select("*", F.explode_outer(F.array(rules)).alias("rules"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.08, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept), one row a document.

    ``score`` is the mean log ratio of a document's word and word-pair buckets, so it does not depend on length; ``kept``
    asks for at least ``threshold`` and for the base rules.  Clean text scores near zero whatever its language, as the target is part
    of the corpus.  Windows of five words are compared by 64-bit hashes.  Null texts have no words and fail; repeated
    rows are judged alike; without trusted labels every score is zero; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return measure(rows, "text", fit(docs, labels, buckets), threshold).select("doc_id", "rules.*")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.08, buckets: int = 10_000) -> DataFrame:
    """The documents that :func:`quality` keeps, all their columns unchanged."""
    rows = with_whole_row(docs).withColumn("text", F.col("row.text"))
    return measure(rows, "text", fit(docs, labels, buckets), threshold).where("rules.kept").select("row.*")
