"""A keyed table of parquet files that batches update bucket by bucket."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage


class UpsertTable:
    """Rows by key below ``path``, hashed into ``buckets``; a batch rewrites the buckets its keys fall into and no others.

    A batch writes ``data/v=<id>/_bucket=<b>`` and then, last, ``manifest/<id>.json``: which version holds each bucket.
    Readers take the newest manifest, so a batch that fails half-way changes nothing, and a repeated batch id
    starts again from the manifest before it.  Files that neither the newest manifest nor the one before it names are removed.
    Of rows with one key the last batch wins; within a batch the greatest row in the order of its columns.  Columns that one
    side lacks become null.  Usable as ``foreachBatch``: one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _listed(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name in self._listed("manifest") if name.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket → the version that holds it, by the newest manifest (below ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        fs, path = self._fs("manifest", f"{known[-1]}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["buckets"] != self.buckets or found["key"] != self.key:
            raise ValueError("the table has other keys or another number of buckets")
        return {int(b): v for b, v in found["at"].items()}

    def _put_manifest(self, version: int, at: dict[int, int]) -> None:
        fs, path = self._fs("manifest", f"{version}.json")
        _, aside = self._fs("manifest", f".{version}.aside")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps({"key": self.key, "buckets": self.buckets, "at": at}).encode()))
        stream.close()
        fs.delete(path, False)
        if not fs.rename(aside, path):
            raise OSError(f"manifest {version} could not be moved in place")

    def _read(self, at: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/_bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table as the newest manifest (below ``before``) has it; None while it has no rows."""
        return self._read(self.manifest(before))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        at = self.manifest(batch_id)
        one = top_per_key(batch, self.key, [F.struct(*[F.col(c) for c in sorted(batch.columns)]).desc()], 1, "_keep").drop("_keep")
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = cut_lineage(one.withColumn("_bucket", bucket))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            old = self._read({b: at[b] for b in touched if b in at})
            rows = new
            if old is not None:
                same = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)])
                met = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(self.key)]
                stay = old.join(same, met, "left_anti").withColumn("_bucket", bucket)
                rows = stay.unionByName(new, allowMissingColumns=True)
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v={batch_id}")
        self._put_manifest(batch_id, at | {b: batch_id for b in touched})
        self._clean()

    def _clean(self) -> None:
        *older, _, _ = [None, None, *self.versions()]
        for version in [v for v in older if v is not None]:
            self._fs()[0].delete(self._fs("manifest", f"{version}.json")[1], False)
        kept = self.versions()
        used = {(v, b) for known in ([None, *kept[1:]] if kept else []) for b, v in self.manifest(known).items()}
        for name in self._listed("data"):
            version = int(name[2:])
            if version not in {v for v, _ in used}:
                self._fs()[0].delete(self._fs("data", name)[1], True)
                continue
            for part in self._listed(f"data/{name}"):
                if part.startswith("_bucket=") and (version, int(part[8:])) not in used:
                    self._fs()[0].delete(self._fs("data", name, part)[1], True)
