"""Session defaults, the shared work folder, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "tieline", **conf: str) -> SparkSession:
    """Build a session with UTC time, AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one ``spark.checkpoint.dir`` names.  Only when that is unset and the master is
    ``local`` a temporary folder takes its place; on a cluster, whose machines share no such folder, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared work folder and go on from there.

    An iterative plan stays short and survives executor loss.  Unlike a checkpointed plan the
    table carries true sizes, so small iterates are broadcast, and no constraints inherited from
    earlier rounds, whose inference grows from round to round.
    """
    spark = df.sparkSession
    path = work_dir(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_steps(*tables: DataFrame) -> None:
    """Delete the files of tables by :func:`cut_lineage` that nothing reads any more, and let Spark clear the shuffles behind them.

    Spark removes shuffle files once the driver's collector has seen that no plan holds them.
    """
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def drop_step(df: DataFrame) -> None:
    """:func:`drop_steps` of one table."""
    drop_steps(df)
