"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster that is an error, as executors would write where nobody reads.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are read more than once, computed once: written as a table in the shared folder."""
    folder = shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


#: Bytes of rows that Spark sends to Python at a time; its own default of 64 MB takes several hundred MB of an executor's memory.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """For queries, which are applications of the operators: a small bound on Arrow batches, unless the session has set one of its own.

    The operators themselves leave the session's settings alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) == 64 << 20:
        spark.conf.set(key, str(BATCH_BYTES))
