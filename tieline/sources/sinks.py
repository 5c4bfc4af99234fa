"""Keyed table maintenance: upsert, partial update, resume, files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """New rows replace old rows of the same key; columns missing on one side become NULL.

    ``order`` picks one row per key when ``new`` holds repeats (the first in order wins).
    """
    key = list(key)
    if order is not None:
        new = top_per_key(new, key, order, 1, "_keep").drop("_keep")
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_columns(table: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrites ``columns`` where the key exists; rows of ``new`` without a partner are left out."""
    side = new.select(F.col(key), F.struct(*columns).alias("_new"))
    joined = table.join(side, key, "left")
    keep = [c for c in table.columns if c not in columns]
    return joined.select(
        *keep, *[(F.coalesce(f"_new.{c}", F.col(c)) if c in table.columns else F.col(f"_new.{c}")).alias(c) for c in columns]
    )


def skipped(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of an update whose key is not in the table yet."""
    return new.join(table.select(key), key, "left_anti")


def remaining(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Resume filter: rows whose key is not done yet."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def merge_graph(old: DataFrame | None, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Idempotent node or edge table: one row per key, the new properties winning."""
    fresh = top_per_key(new, list(key), order, 1, "_keep").drop("_keep")
    return fresh if old is None else upsert(old, fresh, key)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append-only checkpoint log; readers take the last record per key."""
    df.write.mode("append").json(path)


def write_json_arrays(df: DataFrame, path: str, rows: int = 10_000, field: str | None = None) -> None:
    """Files that hold one JSON array each of about ``rows`` rows (under ``field`` of an object, if named), not one a line.

    Rows are written once before and dealt to files by their place there, so repeated rows spread and a repeated task deals alike.
    """
    df = cut_lineage(df)
    buckets = max(1, -(-df.count() // rows))
    dealt = df.select(F.struct("*").alias("_row"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("_file"))
    body = dealt.groupBy("_file").agg(F.collect_list("_row").alias("_rows"))
    text = F.to_json(F.struct(F.col("_rows").alias(field)) if field else F.col("_rows"))
    body.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_back(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write and read again, for tables that later stages scan more than once."""
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)
