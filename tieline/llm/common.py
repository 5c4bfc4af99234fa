"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, as_bytes: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts empty; further columns of any name go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (text.cast("binary") if as_bytes else text).alias("text"))


def per_row(df: DataFrame, fn: Callable[[], Callable[[list, list], dict]], schema: str, names: list[str]) -> DataFrame:
    """``fn()`` is built once a task; the function it returns turns a batch's ids and texts into columns ``names``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in it:
            out = work(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(batches, schema)


def with_whole_row(df: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that added columns cannot clash with the table's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
