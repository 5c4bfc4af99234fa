"""Ranks, quantiles and sequences that never pull one big group into one task.

A plain ``Window.orderBy`` over a whole table, or over a key that holds a third of it,
sorts that data in a single task.  The helpers here first count equal values, split the
value range into buckets, take the running totals of the bucket counts (a few hundred
rows per key) and only then order rows inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


ROWS_A_TASK = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` for ``rows`` rows: a task's share does not grow with the table, as that of a well compressed file does."""
    return df.repartition(rows // ROWS_A_TASK + 1, *keys)


def bucket_count(df: DataFrame) -> int:
    """As many value buckets as the session has shuffle partitions, so that a bucket's share does not grow with the data."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Approximate quantile bounds of a numeric column (``buckets`` driver-side numbers, by default :func:`bucket_count`)."""
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(column).cast("double").alias(column)).approxQuantile(column, probs, min(0.005, 0.25 / buckets))
    return sorted(set(found))


def bucket_of(column: Column, bounds: Sequence[float], base: int = 0) -> Column:
    """Index of the bucket holding a value: a balanced ``CASE`` tree, so it stays in codegen."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(column <= F.lit(bounds[mid]), bucket_of(column, bounds[:mid], base)).otherwise(
        bucket_of(column, bounds[mid + 1:], base + mid + 1)
    )


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Per key and distinct value: ``n_equal`` rows hold it, ``n_below`` rows are smaller, ``n_total`` in all.

    Everything about ranks follows: competition rank ``n_below + 1``, average rank
    ``n_below + (n_equal + 1) / 2``.  NULL values are left out.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_equal"))
    bounds = split_points(df, value, buckets)
    counts = counts.withColumn("_bucket", bucket_of(F.col(value).cast("double"), bounds))
    per_bucket = counts.groupBy(*keys, "_bucket").agg(F.sum("n_equal").alias("_in_bucket"))
    over_buckets = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = per_bucket.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_in_bucket").over(over_buckets.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
        F.sum("_in_bucket").over(over_buckets).alias("n_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    running = F.coalesce(F.sum("n_equal").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_running", running)
    on = [*keys, "_bucket"]
    return ranked.join(before, on).select(
        *keys, value, "n_equal", (F.col("_before") + F.col("_running")).alias("n_below"), "n_total"
    )


def average_rank() -> Column:
    """Rank with ties averaged, over the columns of :func:`value_ranks`."""
    return F.col("n_below") + (F.col("n_equal") + 1) / F.lit(2.0)


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), prefix: str = "q"
) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: columns ``q0``, ``q1``, … in the order of ``probs``.

    Also returns ``n`` (non-null rows).  Works on distinct values with counts, so the memory
    need does not grow with the size of a group.
    """
    keys = list(keys)
    ranked = value_ranks(df, value, keys)
    v = F.col(value).cast("double")
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        holds = lambda at: (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n_equal"))
        lower = F.max(F.when(holds(low), v))
        upper = F.max(F.when(holds(high), v))
        frac = F.max(pos - low)
        cols.append((lower + (upper - lower) * frac).alias(f"{prefix}{i}"))
    return ranked.groupBy(*keys).agg(F.max("n_total").alias("n"), *cols)


def sequenced(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slot: Column,
    previous: Sequence[str] = (),
) -> DataFrame:
    """Number the rows of each key in order, with values of the row before, split by time slot.

    ``slot`` must grow with the ordering (for example the day of the date that leads it).
    Adds ``position`` (from 0), ``n_in_key`` and ``prev_<column>`` for every name in
    ``previous``.  A key holding a large share of all rows is spread over its slots; only one
    small summary row per (key, slot) is ordered per key.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "_slot").orderBy(*order)
    local = df.withColumn("_slot", slot)
    local = local.withColumn("_rn", F.row_number().over(w))
    for name in previous:
        local = local.withColumn(f"_lag_{name}", F.lag(name).over(w))
    picks = [F.max_by(F.struct(*previous), "_rn").alias("_last")] if previous else []
    slots = local.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"), *picks)
    ws = Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_last())
    slots = slots.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_n").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_in_key"),
        *([F.lag("_last").over(ws).alias("_carry")] if previous else []),
    )
    left, right = local.alias("l"), slots.alias("r")
    cond = F.col("l._slot").eqNullSafe(F.col("r._slot"))
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = left.join(right, cond).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("r._offset") + F.col("l._rn") - 1).alias("position"),
        F.col("r.n_in_key").alias("n_in_key"),
        *[
            F.when(F.col("l._rn") > 1, F.col(f"l._lag_{name}"))
            .otherwise(F.col(f"r._carry.{name}"))
            .alias(f"prev_{name}")
            for name in previous
        ],
    )
    return out


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The ``row_number`` filter is planned as a per-partition limit before the shuffle, so at
    most ``k`` rows per key and map task travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
