"""Small helpers of the llm operators; intermediates are the library's (pointloom.storage)."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.storage import new_folder, written

__all__ = ["new_folder", "written", "digits_crc", "text_or_empty", "parallel", "trim", "bound_batches"]


def digits_crc(column: str = "doc_id"):
    """crc32 of an id's decimal text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def parallel(df: DataFrame, tasks: int = 0) -> DataFrame:
    """At least as many partitions as the cluster has cores; nothing moves when there are enough already."""
    want = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside those of other stages."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows that go to a Python worker at once, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Has Spark send whole texts to Python BATCH_ROWS rows at a time, or fewer if the session says so: its 10,000 long texts are beyond a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
