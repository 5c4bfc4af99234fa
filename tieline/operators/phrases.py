"""Where many phrases stand in many texts: one pass over the texts, one row a find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The last bytes of a phrase that decide first.
END = 4
END_BITS = 22
MOST_BITS = 27
CHUNK = 8 * 4096
TEXT_BYTES = 1 << 22


def _ends(data: np.ndarray) -> np.ndarray:
    """A slot for every ``END`` bytes that follow each other."""
    v = data.astype(np.uint32)
    last = v[:-3] | v[1:-2] << np.uint32(8) | v[2:-1] << np.uint32(16) | v[3:] << np.uint32(24)
    return (last * np.uint32(2654435761)) >> np.uint32(32 - END_BITS)


def _digests(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(starts), size, np.uint64)
    for k in range(size):
        h = (h ^ data[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slots(digests: np.ndarray, bits: int):
    mask = np.uint64((1 << bits) - 1)
    return (digests & mask).astype(np.int64), ((digests >> np.uint64(32)) & mask).astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls and the row borders in them."""
    column = column.cast(pa.binary())
    borders = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def _filters(keys: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """(byte lengths, table of ends, bits of two digest slots a phrase, log of their number); 17 MB at most, whatever the phrases."""
    sizes = {r["size"]: r["n"] for r in keys.groupBy(F.octet_length("low").alias("size")).agg(F.count("*").alias("n")).collect()}
    bits = min(MOST_BITS, max(20, (32 * sum(sizes.values())).bit_length()))

    def mark(batches):
        ends, marks = np.zeros(1 << END_BITS, bool), np.zeros(1 << bits, bool)
        for batch in batches:
            data, borders = _bytes(batch.column("low"))
            lengths = np.diff(borders)
            for size in np.unique(lengths):
                starts = borders[:-1][lengths == size]
                for at in _slots(_digests(data, starts, int(size)), bits):
                    marks[at] = True
                if size >= END:
                    last = data[(starts + size - END)[:, None] + np.arange(END)]
                    ends[[_ends(x)[0] for x in np.unique(last, axis=0)]] = True
        for kind, table in enumerate((ends, marks)):
            packed = np.packbits(table, bitorder="little").reshape(-1, CHUNK // 8)
            used = np.flatnonzero(packed.any(axis=1))
            if len(used):
                chunks = pa.array([packed[i].tobytes() for i in used], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int32()), chunks], names=["kind", "at", "bits"])

    parts = keys.mapInArrow(mark, "kind int, at int, bits binary").groupBy("kind", "at").agg(F.bitmap_or_agg("bits").alias("bits"))
    packed = [np.zeros(1 << END_BITS - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)]
    for r in parts.toLocalIterator():
        packed[r["kind"]].reshape(-1, CHUNK // 8)[r["at"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return sorted(n for n in sizes if n), np.unpackbits(packed[0], bitorder="little").view(bool), packed[1], bits


def finds(texts: DataFrame, fields: dict[str, Column], phrases: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``…, field, low): the phrases (low, distinct) that each field of each row holds, each once.

    A place in a text counts when the last bytes before it are the end of some phrase and the digest of a phrase's length is
    marked; what is left meets the phrases by equality, so nothing but real finds remains.  The texts themselves are neither
    shuffled nor cut into rows.
    """
    keys = phrases.select("low", F.encode("low", "utf-8").alias("_bytes"))
    sizes, ends, marks, bits = _filters(keys.select(F.col("_bytes").alias("low")))
    shared = texts.sparkSession.sparkContext.broadcast((ends, marks))
    names = list(fields)

    def places(data: np.ndarray, borders: np.ndarray):
        """(row, start, size) of every place that passes."""
        ends, marks = shared.value
        first = np.flatnonzero(ends[_ends(data)]) + END if len(data) >= END else np.zeros(0, np.int64)
        for size in sizes:
            stops = first if size >= END else np.arange(size, len(data) + 1)
            rows = np.searchsorted(borders, stops - 1, "right") - 1
            inside = stops - size >= borders[rows]
            rows, starts = rows[inside], stops[inside] - size
            one, two = _slots(_digests(data, starts, size), bits)
            ok = (marks[one >> 3] >> (one & 7).astype(np.uint8)) & (marks[two >> 3] >> (two & 7).astype(np.uint8)) & np.uint8(1)
            for row, start in zip(rows[ok > 0].tolist(), starts[ok > 0].tolist(), strict=True):
                yield row, start, size

    def look(batches):
        for batch in batches:
            for name in names:
                data, borders = _bytes(batch.column("_text_" + name))
                found, lo = set(), 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + TEXT_BYTES, "right")) - 1)
                    part = data[borders[lo] : borders[hi]]
                    found.update((lo + row, part[at : at + size].tobytes()) for row, at, size in places(part, borders[lo : hi + 1] - borders[lo]))
                    lo = hi
                if found:
                    rows, lows = zip(*sorted(found), strict=True)
                    kept = [batch.column(c).take(pa.array(rows)) for c in keep]
                    columns = [*kept, pa.array([name] * len(rows), pa.string()), pa.array(lows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "field", "_bytes"])

    read = texts.select(*keep, *[F.encode(F.lower(F.coalesce(c, F.lit(""))), "utf-8").alias("_text_" + n) for n, c in fields.items()])
    schema = T.StructType([*[f for f in read.schema.fields if f.name in keep], T.StructField("field", T.StringType()), T.StructField("_bytes", T.BinaryType())])
    return read.mapInArrow(look, schema).join(keys, "_bytes").select(*keep, "field", "low")
