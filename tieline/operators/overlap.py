"""Overlap of two texts per row: token F1, Jaccard, character bigrams, fuzzy recall."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieline.functions import text as X


@F.pandas_udf(T.LongType())
def _shared_tokens(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """How many tokens two lists share, repeats counted."""
    return pd.Series([sum((Counter(p) & Counter(g)).values()) for p, g in zip(pred, gold, strict=True)], dtype="int64")


def token_f1(df: DataFrame, key: str, pred: Column, gold: Column) -> DataFrame:
    """(key, n_pred, n_gold, n_same, f1): token-overlap F1 of each row, 1 when both sides are empty.

    A row needs nothing but itself: the multiset intersection is counted in Arrow batches, without a shuffle.
    """
    none = F.array().cast("array<string>")
    s = df.select(key, F.coalesce(X.answer_tokens(pred), none).alias("_p"), F.coalesce(X.answer_tokens(gold), none).alias("_g"))
    s = s.select(key, F.size("_p").cast("bigint").alias("n_pred"), F.size("_g").cast("bigint").alias("n_gold"), _shared_tokens("_p", "_g").alias("n_same"))
    f1 = (
        F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0)
        .when(F.col("n_same") == 0, 0.0)
        .otherwise(2.0 * F.col("n_same") / (F.col("n_pred") + F.col("n_gold")))
    )
    return s.withColumn("f1", f1)


def best_f1(df: DataFrame, key: str, pred: str, options: str) -> DataFrame:
    """(key, f1): the best token F1 over a list of accepted answers."""
    rows = df.select(key, pred, F.posexplode(options).alias("_opt", "_gold")).withColumn("_row", F.struct(key, "_opt"))
    scored = token_f1(rows, "_row", F.col(pred), F.col("_gold"))
    return scored.groupBy(F.col(f"_row.{key}").alias(key)).agg(F.max("f1").alias("f1"))


def diagnostics(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Jaccard (4 digits), shared and own token counts, length ratio (3 digits)."""
    ta, tb = F.array_distinct(X.alnum_tokens(a)), F.array_distinct(X.alnum_tokens(b))
    na = F.greatest(F.length(F.coalesce(a, F.lit(""))), F.lit(1))
    nb = F.greatest(F.length(F.coalesce(b, F.lit(""))), F.lit(1))
    sets = df.select(key, ta.alias("_a"), tb.alias("_b"), na.alias("_na"), nb.alias("_nb"))
    return sets.select(
        key,
        F.round(X.jaccard(F.col("_a"), F.col("_b")), 4).alias("jaccard"),
        F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("shared_tokens"),
        F.size("_a").cast("bigint").alias("first_tokens"),
        F.size("_b").cast("bigint").alias("second_tokens"),
        F.round(F.col("_na") / F.col("_nb"), 3).alias("length_ratio"),
    )


def _bigrams(text: Column, n: int) -> Column:
    """The ``n`` most frequent character pairs of each text with their counts, the earliest first on ties; blanks count as one."""

    @F.arrow_udf("array<struct<gram:string,count:bigint>>")
    def top(texts: pa.Array) -> pa.Array:
        # One text at a time leaves Arrow; Counter keeps the order of first occurrence, and most_common is stable.
        ends, grams, counts = [0], [], []
        for text in texts:
            for gram, count in Counter(map("".join, pairwise(text.as_py()))).most_common(n):
                grams.append(gram)
                counts.append(count)
            ends.append(len(grams))
        found = pa.StructArray.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["gram", "count"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return top(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def top_bigrams(df: DataFrame, key: str, text: Column, n: int = 10) -> DataFrame:
    """(key, gram, count, rank): most frequent character pairs of each row, the earliest first on ties; no shuffle."""
    found = df.select(key, F.posexplode(_bigrams(text, n)).alias("_at", "_g"))
    return found.select(key, "_g.gram", "_g.count", (F.col("_at") + 1).alias("rank"))


def bigram_jaccard(df: DataFrame, key: str, a: Column, b: Column, n: int = 10) -> DataFrame:
    """(key, jaccard) over each side's top bigrams; 1 when both are empty, 0 when one is."""
    sets = df.select(key, _bigrams(a, n)["gram"].alias("_a"), _bigrams(b, n)["gram"].alias("_b"))
    union = F.size(F.array_union("_a", "_b"))
    return sets.select(key, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("_a", "_b")) / union).alias("jaccard"))


def fuzzy_recall(retrieved: DataFrame, sources: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, recall): 1 when any retrieved body's token Jaccard with the source reaches the threshold.

    ``retrieved``: key, body.  ``sources``: key, source.
    """
    rows = sources.join(retrieved, key, "left").select(
        key, F.array_distinct(X.answer_tokens(F.col("source"))).alias("_s"), F.array_distinct(X.answer_tokens(F.col("body"))).alias("_b")
    )
    hit = (F.size("_s") > 0) & (F.size("_b") > 0) & (X.jaccard(F.col("_s"), F.col("_b")) >= threshold)
    return rows.groupBy(key).agg(F.max(hit.cast("double")).alias("recall"))
