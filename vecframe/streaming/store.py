"""K5, ST1: a stored collection that a batch of upserts changes only where it has keys.

Rows lie in Parquet folders ``data/v=<version>/kind=<base|delta>/bucket=<hash of the key>``.
A batch is written as deltas, one folder for each bucket it has keys in: nothing else is read
or rewritten. A bucket whose deltas have grown to COMPACT_SHARE of its base, or to
COMPACT_DELTAS folders, is written anew as a base in the same version. ``manifest/v=<version>``
lists the folders that make up a version and is written last, so a version is there as a whole or
not at all. A reader keeps to the folders of one manifest; folders are removed only when no
manifest younger than ``retain_seconds`` names them.

A batch that is replayed with its number makes the same version again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.operators.ingest import newest_rows

COMPACT_SHARE = 0.5
COMPACT_DELTAS = 8
RETAIN_SECONDS = 24 * 3600
MANIFEST = "v long, kind string, bucket int, rows long"
PARTS = {"v", "kind", "bucket"}  # of a folder's path


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass(frozen=True)
class KeyedStore:
    """A collection with the unique key ``key`` under ``path``, in ``buckets`` parts."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def __post_init__(self):
        if clash := PARTS & {n.lower() for n in self.schema.names}:
            raise ValueError(f"columns {sorted(clash)} are the store's own")

    # -- versions

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        fs, root = _path(self.spark, f"{self.path}/manifest")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in found if fs.exists(_path(self.spark, f"{self.path}/manifest/v={v}/_SUCCESS")[1]))

    def folders(self, version: int | None = None, before: int | None = None) -> list:
        """Manifest rows of a version (the newest, or the newest older than ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known or (version is not None and version not in known):
            return []
        at = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={at}/rows.parquet").collect()  # a row for each folder

    # -- reading

    def _rows(self, folders: list) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())]))
        paths = [f"{self.path}/data/v={f['v']}/kind={f['kind']}/bucket={f['bucket']}" for f in folders]
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths)
        return read.select(*self.schema.names, F.col("v").cast("long").alias("v"), F.col("bucket").cast("int").alias("bucket"))

    def _merged(self, folders: list) -> DataFrame:
        """The rows of these folders without those that a later delta replaces. Only the keys of
        deltas take part in the join, and only buckets that have deltas are joined at all."""
        deltas = [f for f in folders if f["kind"] == "delta"]
        changed = {f["bucket"] for f in deltas}
        settled = self._rows([f for f in folders if f["bucket"] not in changed])
        if not deltas:
            return settled
        rows = self._rows([f for f in folders if f["bucket"] in changed])
        newer = self._rows(deltas).groupBy(F.col(self.key).alias("_key")).agg(F.max("v").alias("_v"))
        kept = rows.join(newer, (F.col(self.key) == F.col("_key")) & (F.col("v") < F.col("_v")), "left_anti")
        return settled.unionByName(kept)

    def read(self, version: int | None = None) -> DataFrame:
        """The collection as of a version (the newest)."""
        return self._merged(self.folders(version)).select(*self.schema.names)

    # -- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, kind: str) -> None:
        # a bucket that holds much of the batch is split by size, small ones share a task
        placed = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}/kind={kind}")

    def _written(self, version: int, kind: str) -> list[tuple]:
        folder = f"{self.path}/data/v={version}/kind={kind}"
        fs, p = _path(self.spark, folder)
        if not any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p)):
            return []
        counted = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
        return [(version, kind, r[0], r[1]) for r in counted.groupBy("bucket").count().collect()]  # a row for each bucket

    def _commit(self, version: int, folders: list[tuple]) -> None:
        frame = self.spark.createDataFrame(sorted(folders), MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}/rows.parquet")
        fs, done = _path(self.spark, f"{self.path}/manifest/v={version}/_SUCCESS")
        fs.create(done, True).close()

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """Start the collection with ``rows``, whose keys are unique."""
        self._write(rows.where(F.col(self.key).isNotNull()).select(*self.schema.names), version, "base")
        self._commit(version, self._written(version, "base"))

    def upsert(self, batch: DataFrame, seq_col: str, version: int) -> None:
        """Insert or replace by key; in the batch the row with the highest ``seq_col`` wins (ties
        by a hash of the row). ``version`` is greater than all before, or that of a batch that is
        replayed. Rows without a key are an error, as for a primary key."""
        before = [tuple(f) for f in self.folders(before=version)]
        if not batch.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError("a row has no key")
        self._write(newest_rows(batch, self.key, seq_col, [n for n in self.schema.names if n != self.key]).select(*self.schema.names), version, "delta")
        made = self._written(version, "delta")
        folders = self._compacted(before + made, version)
        self._commit(version, folders)

    def _compacted(self, folders: list[tuple], version: int) -> list[tuple]:
        """The folders, with a new base for buckets whose deltas have become many or large."""
        base, deltas, count = {}, {}, {}
        for _, kind, bucket, rows in folders:
            if kind == "base":
                base[bucket] = rows
            else:
                deltas[bucket], count[bucket] = deltas.get(bucket, 0) + rows, count.get(bucket, 0) + 1
        due = {b for b in deltas if count[b] >= COMPACT_DELTAS or deltas[b] >= COMPACT_SHARE * max(1, base.get(b, 0))}
        if not due:
            return folders
        named = [dict(zip(("v", "kind", "bucket", "rows"), f, strict=True)) for f in folders if f[2] in due]
        self._write(self._merged(named).select(*self.schema.names), version, "base")
        return [f for f in folders if f[2] not in due] + self._written(version, "base")

    # -- removal

    def expire(self, retain_seconds: float = RETAIN_SECONDS, now: float | None = None) -> int:
        """Remove manifests older than ``retain_seconds`` (never the newest two: the current one
        and the one a replayed batch starts from) and the folders that no remaining one names.
        How many folders went."""
        known = self.versions()
        limit = ((now or time.time()) - retain_seconds) * 1000
        old = []
        for v in known[:-2]:
            fs, p = _path(self.spark, f"{self.path}/manifest/v={v}/_SUCCESS")
            if fs.getFileStatus(p).getModificationTime() < limit:
                old.append(v)
        keep = {(f["v"], f["kind"], f["bucket"]) for v in known if v not in old for f in self.folders(v)}
        gone = {(f["v"], f["kind"], f["bucket"]) for v in old for f in self.folders(v)} - keep
        for v, kind, bucket in gone:
            fs, p = _path(self.spark, f"{self.path}/data/v={v}/kind={kind}/bucket={bucket}")
            fs.delete(p, True)
        for v in old:
            fs, p = _path(self.spark, f"{self.path}/manifest/v={v}")
            fs.delete(p, True)
        return len(gone)


def start_store_upsert(store: KeyedStore, source_dir: str, source_schema: T.StructType, checkpoint_dir: str, seq_col: str = "seq",
                       available_now: bool = True, retain_seconds: float = RETAIN_SECONDS):
    """ST1: files of ``source_schema`` (the store's columns and ``seq_col``) arriving in
    ``source_dir`` are upserted batch by batch; a micro-batch writes only its own rows and the
    buckets that are due for a new base. Returns the ``StreamingQuery``. The version of a
    micro-batch follows from its number, so a replay changes nothing."""
    first = max(store.versions(), default=-1)
    fs, mark = _path(store.spark, f"{checkpoint_dir}/offsets")
    if fs.exists(mark):  # a stream that goes on: batch numbers continue from the store's first version
        first = int(store.spark.read.text(f"{checkpoint_dir}/first-version").first()[0])
    else:
        store.spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.mode("overwrite").text(f"{checkpoint_dir}/first-version")

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, seq_col, first + 1 + batch_id)
        store.expire(retain_seconds)

    stream = store.spark.readStream.schema(source_schema).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
