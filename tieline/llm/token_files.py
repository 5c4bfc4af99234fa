"""Operator 7: token ids as binary shards with Elias-Fano coded document boundaries.

A shard is two files: ``ids-N.bin``, the ids of all its documents as little-endian unsigned integers, and
``docs-N.idx``, the document ids and the Elias-Fano code of the documents' ends.  Shards follow each other in ascending
document id.  A manifest table (one row a shard) lists files and counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tieline.llm.common import doc_texts
from tieline.llm.eliasfano import EliasFano
from tieline.llm.subwords import library_encoder

MANIFEST = "shard bigint, ids_file string, index_file string, n_docs bigint, n_ids bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_INDEX = struct.Struct("<4sBQ")


def _index_bytes(doc_ids: list[int | None], ends: list[int], width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)  # nulls sort first
    ids = np.asarray(doc_ids[nulls:], dtype="<i8").tobytes()
    return _INDEX.pack(b"TIDX", width, nulls) + EliasFano.of(np.asarray(ends), ends[-1]).to_bytes().join([struct.pack("<Q", len(ids)) + ids, b""])


def _read_index(raw: bytes) -> tuple[int, int, np.ndarray, EliasFano]:
    mark, width, nulls = _INDEX.unpack_from(raw)
    if mark != b"TIDX":
        raise ValueError("not an index file")
    (size,) = struct.unpack_from("<Q", raw, _INDEX.size)
    at = _INDEX.size + 8
    return width, nulls, np.frombuffer(raw, "<i8", count=size // 8, offset=at), EliasFano.from_bytes(raw[at + size :])


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, shards: int | None = None, width: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards below ``path``; returns the manifest.

    ``shards`` ranges of document ids (default: the session's shuffle partitions).  Each task streams its sorted range into
    files of fixed names, written aside and moved in place, so a repeated task leaves the same files.  ``path`` is any
    place that pyarrow's file systems and Spark both reach.  Null texts count as empty, null ids come first, rows that
    share an id stand in the order of their texts, an empty table writes no shard.  ``width`` bytes hold an id; a larger id raises.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        shard = TaskContext.get().partitionId()
        aside = f"{base}/.aside-{shard}-{TaskContext.get().taskAttemptId()}"
        encode = library_encoder(tokenizer_file)
        end = np.asarray([end_id], "<u4").tobytes()
        doc_ids, ends, total, out = [], [], 0, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(aside)
                ids = np.frombuffer(encode(text) + end, "<u4")
                if width < 4 and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id does not fit into {width} bytes")
                out.write(ids.astype(f"<u{width}").tobytes())
                total += len(ids)
                doc_ids.append(doc_id)
                ends.append(total)
        if out is None:
            return
        out.close()
        names = [f"{base}/ids-{shard:06d}.bin", f"{base}/docs-{shard:06d}.idx"]
        with store.open_output_stream(f"{aside}.idx") as index:
            index.write(_index_bytes(doc_ids, ends, width))
        for source, name in zip((aside, f"{aside}.idx"), names, strict=True):
            if store.get_file_info(name).type != fs.FileType.NotFound and store.type_name != "local":
                store.delete_file(name)
            store.move(source, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "ids_file": [names[0].rsplit("/", 1)[1]], "index_file": [names[1].rsplit("/", 1)[1]], "n_docs": [len(ends)], "n_ids": [total]})

    rows = doc_texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, tasks: int | None = None, at_once: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, in the order of the ids.

    A task reads one shard: its index, then its ids front to back, ``at_once`` documents at a time.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row a shard: the running total needs no more than that.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("ids_file", "index_file", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{base}/{row['index_file']}") as f:
                    width, nulls, doc_ids, bounds = _read_index(f.read())
                with store.open_input_stream(f"{base}/{row['ids_file']}") as f:
                    start = 0
                    for i in range(0, bounds.n, at_once):
                        ends = bounds.window(i, at_once).tolist()
                        cols = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
                        for k, end in enumerate(ends, i):
                            ids = np.frombuffer(f.read((end - start) * width), f"<u{width}")
                            cols["doc_id"].append(None if k < nulls else int(doc_ids[k - nulls]))
                            cols["start"].append(row["base"] + start)
                            cols["n_tokens"].append(len(ids))
                            cols["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start = end
                        yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([(c, pa.int64()) for c in cols]))

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(tasks).mapInArrow(read, DOCUMENTS)
