"""Table jobs around a caller-supplied model function."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tieline.functions.payloads import parse_object

log = logging.getLogger(__name__)


def embed_column(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 16, failures: bool = False) -> DataFrame:
    """(key, embedding) by batches; a failed batch is logged and left out, for the next run to pick up.

    With ``failures`` its rows come too, without embedding, and a column ``failure`` names the error.
    """
    kind = dict(df.dtypes)[key]

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                failure = None
                try:
                    vectors = [[float(x) for x in v] for v in embed(part[text].fillna("").tolist())]
                except Exception as e:  # noqa: BLE001
                    log.warning("batch of %d skipped: %s", len(part), e)
                    if not failures:
                        continue
                    vectors, failure = [None] * len(part), f"{type(e).__name__}: {e}"
                out = pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors})
                yield out.assign(failure=failure) if failures else out

    schema = f"{key} {kind}, embedding array<float>" + (", failure string" if failures else "")
    return df.select(key, text).mapInPandas(run, schema)


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic bag-of-words vectors, for tests and dry runs."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dims] += 1.0
            out.append(v)
        return out

    return embed


def _attempts(ask: Callable[[str], str], text: str, attempts: int, wait: float) -> tuple[str | None, int, str | None]:
    """(payload, attempts made, failure) of one prompt."""
    failure = None
    for n in range(1, attempts + 1):
        try:
            found = parse_object(ask(text))
        except (ConnectionError, TimeoutError) as e:
            failure = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(wait * 2 ** (n - 1))
            continue
        except Exception as e:  # noqa: BLE001
            return None, n, f"{type(e).__name__}: {e}"
        if found:
            return found, n, None
        failure = "no JSON object"
    return None, attempts, failure


def extract_structured(
    df: DataFrame, key: str, prompt: str, ask: Callable[[str], str], attempts: int = 3, wait: float = 0.5
) -> DataFrame:
    """(key, payload, n_attempts, failure): model answers as JSON text.

    A transient error (ConnectionError, TimeoutError) backs off and tries again, an answer
    without a JSON object tries again at once; other errors end the row.
    """
    kind = dict(df.dtypes)[key]

    def run(frames):
        for pdf in frames:
            rows = [_attempts(ask, t, attempts, wait) for t in pdf[prompt]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "payload": [r[0] for r in rows], "n_attempts": [r[1] for r in rows], "failure": [r[2] for r in rows]})

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, payload string, n_attempts int, failure string")


class AnswerLog:
    """Answers of a model job in an append log below ``path``: a job that was stopped goes on where it stopped.

    Every task appends its answers while it runs, one parquet file for ``flush`` batches, written aside and moved in place.
    A run leaves out the keys that are answered already, and a repeated task those that its earlier attempt has logged,
    so at most the unflushed batches of running tasks are asked twice.  Failed rows are logged with their
    failure and asked again by the next run.  ``path`` has to be a folder that all tasks can write to.

    ``result`` is the Spark type of an answer.  Keys are unique in the log: of repeated rows of one key the one with the smallest
    text is asked, rows without key are left out (nothing could find them again), null texts are asked as empty.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, result: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(f"`{key}` {kind}, result {result}, failure string")

    def _logged(self) -> DataFrame:
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(f"{self.path}/run=start")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/run=*/")

    def read(self) -> DataFrame:
        """(key, result, failure), one row a key: an answer if there is one, of several the one of the last file."""
        order = F.struct(F.col("failure").isNull(), "_metadata.file_modification_time", "_metadata.file_path")
        one = self._logged().groupBy(self.key).agg(F.max_by(F.struct("result", "failure"), order).alias("_one"))
        return one.select(self.key, "_one.result", "_one.failure")

    def run(self, df: DataFrame, text: str, answer: Callable[[list[str]], list[tuple[object, str | None]]], batch: int = 16, flush: int = 64) -> dict[str, int]:
        """Asks for the keys of ``df`` not answered yet; ``answer`` returns (result, failure) for each text of a batch.

        Returns how many rows were answered and how many failed, two numbers a task on their way.
        """
        todo = df.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.coalesce(text, F.lit(""))).alias("_text"))
        answered = self._logged().where("failure is null").select(self.key)
        todo = todo.join(answered, self.key, "left_anti").select(self.key, "_text")
        path, run_id, schema = self.path, uuid.uuid4().hex, to_arrow_schema(self.schema)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(path)
            at = TaskContext.get()
            own = f"{base}/run={run_id}-{at.partitionId()}"
            store.create_dir(own, recursive=True)
            earlier = [f.path for f in store.get_file_info(fs.FileSelector(own)) if f.base_name.endswith(".parquet") and f.base_name[0] != "."]
            finished = {k for f in earlier for k, e in zip(*pq.read_table(f, filesystem=store).select([0, 2]).to_pydict().values(), strict=True) if e is None}
            held, counts, files = [], [0, 0], 0

            def put():
                nonlocal held, files
                name = f"{at.taskAttemptId()}-{files}.parquet"
                table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                pq.write_table(table, f"{own}/.{name}", filesystem=store)
                store.move(f"{own}/.{name}", f"{own}/{name}")
                held, files = [], files + 1

            for part in batches:
                rows = [r for r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if r[0] not in finished]
                counts[0] += part.num_rows - len(rows)
                for i in range(0, len(rows), batch):
                    some = rows[i : i + batch]
                    found = answer([t for _, t in some])
                    held += [(k, r, e) for (k, _), (r, e) in zip(some, found, strict=True)]
                    failed = sum(e is not None for _, e in found)
                    counts = [counts[0] + len(some) - failed, counts[1] + failed]
                    if len(held) >= batch * flush:
                        put()
            if held:
                put()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in counts], names=["answered", "failed"])

        total = todo.mapInArrow(task, "answered bigint, failed bigint").agg(F.sum("answered").alias("answered"), F.sum("failed").alias("failed")).first()
        return {"answered": total["answered"] or 0, "failed": total["failed"] or 0}


def embedding_batches(embed: Callable[[list[str]], Sequence[Sequence[float]]]) -> Callable[[list[str]], list[tuple[object, str | None]]]:
    """Answers for ``AnswerLog`` (array<float>): a batch whose model call raises fails as a whole."""

    def answer(texts: list[str]):
        try:
            return [([float(x) for x in v], None) for v in embed(texts)]
        except Exception as e:  # noqa: BLE001
            log.warning("batch of %d failed: %s", len(texts), e)
            return [(None, f"{type(e).__name__}: {e}")] * len(texts)

    return answer


def payload_answers(ask: Callable[[str], str], attempts: int = 3, wait: float = 0.5) -> Callable[[list[str]], list[tuple[object, str | None]]]:
    """Answers for ``AnswerLog`` (string): one JSON object a prompt, with the attempts of ``extract_structured``."""
    return lambda texts: [(found, failure) for found, _, failure in (_attempts(ask, t, attempts, wait) for t in texts)]
