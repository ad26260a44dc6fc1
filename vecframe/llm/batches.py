"""Sizes of the Arrow batches that text rows travel in."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECORDS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
RECORDS = 1_000
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Documents are large rows: Spark's default of 10,000 rows a batch can be gigabytes of
    text in each task. Unless the session names a number, batches hold RECORDS rows."""
    if RECORDS_KEY not in spark.conf.getAll:
        spark.conf.set(RECORDS_KEY, str(RECORDS))


def light_batches(spark: SparkSession) -> None:
    """Also bounds the bytes of a batch: unless the session names a number, BYTES instead of
    Spark's 64 MB, which a task holds off the heap twice, on its way in and out. A longer row
    travels alone."""
    small_batches(spark)
    if BYTES_KEY not in spark.conf.getAll:
        spark.conf.set(BYTES_KEY, str(BYTES))
