"""Operator 1: packing documents into training sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tieline.llm.common import doc_texts
from tieline.llm.subwords import library_encoder
from tieline.session import cut_lineage

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids and the end id, cut into runs of ``capacity`` and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer_file)
        end = np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return doc_texts(docs).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many sequences use each.

    Lengths go in from the longest; each joins the pattern with the most room left, as often as both counts allow, and
    opens patterns of its own only when none has room.  The work depends on the number of lengths, not of documents.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        widest = capacity
        while left:
            while widest >= length and not room[widest]:
                widest -= 1
            if widest < length:
                room[capacity - length].append((left, (length,)))
                break
            count, pattern = room[widest].pop()
            used = min(count, left)
            if count > used:
                room[widest].append((count - used, pattern))
            room[widest - length].append((used, (*pattern, length)))
            left -= used
    return sorted(((p, c) for packs in room.values() for c, p in packs), reverse=True)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    The histogram has at most ``capacity`` entries whatever the table holds; the driver sees nothing else.  Pieces
    of one length are ranked in groups of about ``group_rows`` whose counts are then added up, so a length that a third
    of all rows share is spread.  Patterns meet pieces by rank.  Null texts count as empty (one end id), null ids and
    repeated rows are kept as pieces of their own, an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, tokenizer_file, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, capacity)

    slots = defaultdict(list)  # length → (pieces it takes, first sequence, offset)
    sequence = 0
    for pattern, count in patterns:
        for length, offset in zip(pattern, accumulate(pattern, initial=0), strict=False):
            slots[length].append((count, sequence, offset))
        sequence += count
    flat = [s for length in sorted(slots) for s in slots[length]]
    starts = np.cumsum([0, *(s[0] for s in flat)])[:-1]
    firsts = np.asarray([s[1] for s in flat], np.int64)
    offsets = np.asarray([s[2] for s in flat], np.int64)
    # At most `capacity` slots for each of `capacity` pattern updates: bounded by the capacity, not the data.
    shared = spark.sparkContext.broadcast((starts, firsts, offsets))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(at: pd.Series) -> pd.DataFrame:
        starts, firsts, offsets = shared.value
        k = np.searchsorted(starts, at.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[k] + at.to_numpy() - starts[k], "offset": offsets[k]})

    lengths = sorted(histogram)
    bases = list(accumulate((histogram[n] for n in lengths), initial=0))
    known = spark.createDataFrame([(n, b, -(-histogram[n] // group_rows)) for n, b in zip(lengths, bases, strict=False)], "length bigint, base bigint, groups bigint")
    # One row a length, at most `capacity` rows.
    pieces = pieces.join(F.broadcast(known), "length")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("groups")))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("rank", inside - 1).join(sizes, ["length", "part"])
    at = ranked.withColumn("place", place(F.col("base") + F.col("before") + F.col("rank")))
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
