"""Derived tables that are kept until a file they came from, or a parameter, changes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def files_digest(spark: SparkSession, *paths: str) -> list:
    """Number, bytes, last change and hash of the files below ``paths``; reads names and times only, no contents.

    The hash adds up over files, so nothing but one row reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    one = files.agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.unix_micros(F.max("modificationTime")), F.lit(0)),
        F.coalesce(F.expr("bit_xor(xxhash64(path, length, modificationTime))"), F.lit(0)),
    )
    return list(one.first())


class TableCache:
    """Named tables below ``folder``, keyed by the files of ``inputs`` and by ``params``.

    ``get(build)`` returns the stored tables if a complete build of this key exists, else it runs ``build``, which returns
    name → DataFrame, and stores what it gives.  A build writes into a folder of its own and its manifest last;
    the manifest holds a digest of every table's files, so a build that was cut off or whose files were changed or lost is
    refused and built anew.  Earlier builds stay for readers that still use them.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: Sequence[str], params: dict | None = None):
        self.spark = spark
        text = json.dumps([sorted(inputs), files_digest(spark, *inputs), params or {}], sort_keys=True)
        self.path = f"{folder.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def _manifest(self) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}/manifest").select(F.max_by("value", "_metadata.file_modification_time")).first()
        except AnalysisException:  # no build yet
            return None
        return json.loads(rows[0]) if rows[0] else None

    def stored(self) -> dict[str, DataFrame] | None:
        """The tables of the last complete build, None if there is none or a table's files are not what was written."""
        found = self._manifest()
        if not found:
            return None
        at = {name: f"{self.path}/{found['build']}/{name}" for name in found["tables"]}
        try:
            if any(files_digest(self.spark, at[name]) != digest for name, digest in found["tables"].items()):
                return None
            return {name: self.spark.read.parquet(path) for name, path in at.items()}
        except AnalysisException:  # a table's folder is gone
            return None

    def get(self, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        found = self.stored()
        if found is not None:
            return found
        name = f"build-{uuid.uuid4().hex}"
        digests = {}
        for table, df in build().items():
            df.write.parquet(f"{self.path}/{name}/{table}")
            digests[table] = files_digest(self.spark, f"{self.path}/{name}/{table}")
        text = json.dumps({"build": name, "tables": digests})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")
        return {table: self.spark.read.parquet(f"{self.path}/{name}/{table}") for table in digests}
