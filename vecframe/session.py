"""Session helpers: building a local session for tests and benches, config lookup,
and the shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Config keys read by the library (all optional, all have defaults).
BROADCAST_BYTES_KEY = "vecframe.search.broadcastBytes"   # bound for a broadcast query block
BLOCK_ROWS_KEY = "vecframe.search.blockRows"             # rows per side in one scoring group
SMALL_KEYS_KEY = "vecframe.smallFrameRows"               # bound for broadcasting small stat frames

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_BLOCK_ROWS = 4096
DEFAULT_SMALL_ROWS = 100_000


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else default


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vecframe") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("VECFRAME_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is. Only where it is
    unset and the master is local (tests) a fresh scratch folder is created and set; on a
    cluster executors would write to their own disks, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="vecframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read from there: for rows
    that are read several times, as whole columns and much smaller than a checkpoint's rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SPREAD_BYTES = 64 * 1024 * 1024

_SHUFFLED = re.compile(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")


def spread(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work (tokenising, hashing, chunking, block scoring) over
    all task slots when the input cannot keep them busy, e.g. a table stored as one large
    Parquet row group (only one scan task gets rows).

    Decided from the plan without running it: after a shuffle the parallelism is already
    the shuffle's; an input of more than SPREAD_BYTES for each slot has splits enough and is
    never shuffled, however few files hold it. Only a small input in fewer files than slots
    is repartitioned: round-robin, or by the ``by`` columns so that later aggregations on
    them need no further exchange."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > slots * SPREAD_BYTES:
        return df
    plan = df._jdf.queryExecution().executedPlan().toString()
    if _SHUFFLED.search(plan):
        return df
    files = df.inputFiles()
    if files:
        parallel = len(files)
    elif "Exchange" in plan:
        return df  # broadcast-only plan over non-file input: leave it to the planner
    else:
        parallel = df.rdd.getNumPartitions()  # pure narrow plan: no job is run
    if parallel >= slots:
        return df
    return df.repartition(slots, *by) if by else df.repartition(slots)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vecframe`` importable by the Python workers of every executor, as
    ``spark-submit --py-files`` would: the package is zipped once per application and
    added with ``addPyFile`` (Spark distributes it). Called before any stage that runs
    Python code (block scoring, LSH signatures, cell assignment, pluggable embedders)."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="vecframe-pkg-"), "vecframe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
