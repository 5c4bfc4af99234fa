"""Operator 11: a reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Row ``r`` of ``n`` goes to position ``permute(r, n, seed)``; position ``p`` is slot ``p // shards`` of shard
``p % shards``.  Both directions are plain arithmetic: no table of positions exists anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.session import cut_lineage

ROUNDS = 8
_PLACES = (1 << 33) - 1  # monotonically_increasing_id: partition above, row of the partition in the low 33 bits


def _mixed(x: np.ndarray, round_key: int) -> np.ndarray:
    """Keyed 64-bit mixing by xor-shifts and odd multipliers (wraps on purpose)."""
    x = x ^ np.uint64(round_key)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return np.random.default_rng(seed).integers(0, 1 << 64, ROUNDS, dtype=np.uint64).tolist()


def _sides(n: int) -> tuple[int, int]:
    """Two factors whose product is the smallest such grid that holds ``n``: less than one row of it lies beyond ``n``."""
    high = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return high, max(1, -(-n // high))


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """``step`` repeated for the values that it leaves outside 0 .. n - 1: still a permutation of that range."""
    x = step(x)
    while (outside := np.flatnonzero(x >= n)).size:
        x[outside] = step(x[outside])
    return x


def permute(rows: Sequence[int] | np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The position of each row number below ``n``: a permutation that depends on ``n`` and ``seed`` alone."""
    high, low = map(np.uint64, _sides(n))
    keys = _round_keys(seed)

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x // low, x % low
        for i, key in enumerate(keys):
            if i % 2:
                b = (b + _mixed(a, key) % low) % low
            else:
                a = (a + _mixed(b, key) % high) % high
        return a * low + b

    return _walk(np.asarray(rows, np.uint64), n, step).astype(np.int64)


def restore(positions: Sequence[int] | np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each position: the inverse of :func:`permute`."""
    high, low = map(np.uint64, _sides(n))
    keys = list(enumerate(_round_keys(seed)))[::-1]

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x // low, x % low
        for i, key in keys:
            if i % 2:
                b = (b + low - _mixed(a, key) % low) % low
            else:
                a = (a + high - _mixed(b, key) % high) % high
        return a * low + b

    return _walk(np.asarray(positions, np.uint64), n, step).astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    slot, shard = divmod(int(permute([row], n, seed)[0]), shards)
    return shard, slot


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number in a slot of a shard."""
    return int(restore([slot * shards + shard], n, seed)[0])


def in_ranges(rows: DataFrame, by: Sequence[str | Column], tasks: int) -> DataFrame:
    """``rows`` in ``tasks`` sorted ranges of ``by``, with ``_at``: the range above 33 bits for the place in it.

    Rows alike in ``by`` follow in the order in which they stand in the input; that order is also the last range key, so
    even a table of one repeated row is dealt evenly.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    order = [*(F.asc_nulls_first(k) for k in keys), F.col("_tie").asc()]
    known = cut_lineage(rows.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = known.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("_tie")
    return cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, by: Sequence[str | Column], tasks: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with their global number ``row`` from 0 in the order of ``by``, and how many there are.

    A running total over one row a range gives each range its first number.
    """
    dealt = in_ranges(rows, by, tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    # One row a range, so the running total and the broadcast are bounded by the number of tasks.
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = cut_lineage(ranges.select("_range", "_n", F.coalesce(before, F.lit(0)).alias("_before")))
    n = ranges.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    joined = dealt.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges.drop("_n")), "_range")
    return joined.withColumn("row", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_PLACES))).select(*rows.columns, "row"), n


def shuffle_rows(rows: DataFrame, by: Sequence[str | Column], shards: int, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``row``, ``shard`` and ``slot``: a shuffle that any run over the same rows repeats.

    Shard sizes differ by one at most and slots are gapless from 0.  Rows alike in ``by`` count as equal: choose ``by`` so
    that such rows are interchangeable.  Null keys come first, an empty table gives no rows.  The columns ``row``, ``shard``
    and ``slot`` must not be in the table yet.
    """
    if clash := {"row", "shard", "slot", "_tie", "_at", "_range"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    placed, n = numbered(rows, by, tasks)

    @F.pandas_udf("bigint")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    out = placed.withColumn("_p", position("row"))
    return out.select(*placed.columns, (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("bigint").alias("slot"))


def document_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest): what orders and describes a document, without its text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(raw) + 1).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("digest"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row), one row a document, by the law ``rows``.

    Documents are numbered by id, then by 64-bit hash, check sum and size of the text, so only narrow rows are shuffled; rows
    alike in all of these are interchangeable.  ``grown_shard`` is null: under this law one more shard moves most rows.
    Null texts have size 1 and check sum 0 and are numbered with the empty texts of their id; null ids come first; very long texts
    only add to their own ``size``; repeated rows get slots of their own; an empty table gives no rows; other columns are not read.
    """
    out = shuffle_rows(document_digests(docs), ["doc_id", "digest", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 0, rows_per_file: int = 1_000_000) -> DataFrame:
    """Whole documents below ``path`` in one folder a shard, in the order of slots within a file; returns them read back.

    ``rows_per_file`` slots in a row go to one task, so a large shard is many files.  Documents meet their slot by id and
    text hash; rows that repeat both take their slots in turn.  The table must not have columns ``shard`` or ``slot``; null texts stay null.
    """
    if clash := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"))
    placed = shuffle_rows(whole, ["doc_id", "digest"], shards, seed).withColumn("file", F.floor(F.col("slot") / rows_per_file))
    dealt = placed.repartitionByRange("shard", "file").sortWithinPartitions("shard", "slot")
    dealt.select("document.*", "shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
