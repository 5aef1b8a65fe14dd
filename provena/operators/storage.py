"""Keeps what must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch where the session sets no bound of its own: each task has several batches at a time in the JVM and in Python.
BATCH_BYTES = "4m"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, an own one if all runs on this machine, else it's an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="provena-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def modest_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless the session does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == "1b":
        spark.conf.set(key, BATCH_BYTES)


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
