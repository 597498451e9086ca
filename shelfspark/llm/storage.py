"""Cutting lineage through the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that setting is absent (unit
tests on one machine) a folder of the driver is used.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"file://{tempfile.gettempdir()}/shelfspark-shared"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    What follows no longer depends on the executors that made it, and Spark knows its true size, so that small
    results are broadcast by Spark's own threshold.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of text that a Python task holds at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def release() -> None:
    """Gives memory that a task no longer uses back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
