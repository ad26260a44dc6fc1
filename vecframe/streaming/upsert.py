"""ST1: incremental upsert of corpus batches arriving as files (Structured Streaming).

Every micro-batch is merged into the stored collection with last-write-wins semantics
(K5) inside ``foreachBatch``. The collection is kept as versioned Parquet folders
``version=<batch_id>``: batch ``b`` reads the newest complete version older than ``b``
and writes version ``b``; versions older than the last ``KEEP_VERSIONS`` are removed after
that, so the store does not grow with the number of batches. A replayed batch (after a failure) rewrites the same version
from the same input, so the sink is idempotent, and each version reads files, never a
growing lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vecframe.operators.ingest import _latest, upsert_last_wins

VERSION_PREFIX = "version="
KEEP_VERSIONS = 2  # the current one, and the one a replayed batch reads


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_versions(spark: SparkSession, store_dir: str) -> list[int]:
    """Complete versions (with a ``_SUCCESS`` marker), ascending."""
    fs, root = _fs(spark, store_dir)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(VERSION_PREFIX):
            marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if fs.exists(marker):
                out.append(int(name[len(VERSION_PREFIX):]))
    return sorted(out)


def version_path(store_dir: str, version: int) -> str:
    return f"{store_dir.rstrip('/')}/{VERSION_PREFIX}{version:012d}"


def read_current(spark: SparkSession, store_dir: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest complete version (older than ``before`` when given); empty if none."""
    versions = [v for v in list_versions(spark, store_dir) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(store_dir, versions[-1]))


def drop_old_versions(spark: SparkSession, store_dir: str, keep: int = KEEP_VERSIONS) -> None:
    """Remove all but the newest ``keep`` complete versions."""
    for version in list_versions(spark, store_dir)[:-keep]:
        fs, path = _fs(spark, version_path(store_dir, version))
        fs.delete(path, True)


def start_stream_upsert(
    spark: SparkSession,
    source_dir: str,
    source_schema: T.StructType,
    store_dir: str,
    checkpoint_dir: str,
    key: str = "id",
    seq_col: str = "seq",
    available_now: bool = True,
):
    """Start the streaming upsert; returns the ``StreamingQuery``.

    ``source_schema`` holds ``key``, ``seq_col`` and the value columns; the stored
    collection keeps ``key`` and the value columns."""
    values = [f for f in source_schema.fields if f.name != seq_col]
    store_schema = T.StructType(values)

    def merge(batch: DataFrame, batch_id: int) -> None:
        base = read_current(spark, store_dir, store_schema, before=batch_id)
        incoming = batch.select(key, seq_col, *[f.name for f in values if f.name != key])
        out = upsert_last_wins(base, incoming, key, seq_col)
        out.write.mode("overwrite").parquet(version_path(store_dir, batch_id))
        drop_old_versions(spark, store_dir)

    stream = spark.readStream.schema(source_schema).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_rows(batch: DataFrame, key: str, seq_col: str) -> DataFrame:
    """Newest row per key of one batch (exposed for tests)."""
    values = [c for c in batch.columns if c not in (key, seq_col)]
    return _latest(batch, key, seq_col, values)
