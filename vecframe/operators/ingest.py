"""Collection maintenance as set operations.

Keyed writes are planned as joins against the key set of the batch; duplicate keys
inside a batch are resolved by hash aggregates over (key, sequence, hash), which combine
map-side, so a key repeated a million times never lands in one task as a million rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.functions.vectors import has_bad_element
from vecframe.operators.ranking import dense_ids


REPEAT_ROWS = 10_000  # repeats of a key listed at once


def _latest(batch: DataFrame, key: str, seq_col: str, value_cols: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key: the newest (or oldest) by ``seq_col``; rows with an equal ``seq_col``
    are ordered by a hash of their values, so the pick never depends on partitioning."""
    pick = F.max_by if newest else F.min_by
    rec = F.struct(*[F.col(c) for c in value_cols])
    order = F.struct(F.col(seq_col), F.xxhash64(*[F.col(c) for c in value_cols]))
    return batch.groupBy(key).agg(pick(rec, order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in value_cols])


def newest_rows(batch: DataFrame, key: str, seq_col: str, value_cols: Sequence[str], newest: bool = True) -> DataFrame:
    """The newest (or oldest) row of each key, as :func:`_latest` picks it, without sorting rows:
    the winning (sequence, hash) is found by hash aggregates over narrow rows and met by one
    join on all three, hashed on the narrow side. The versions of a hot key are spread over
    the tasks. Winners equal in all columns become one; rows without a key are left out."""
    values = [F.col(c) for c in value_cols]
    pick = F.max if newest else F.min
    hashed = batch.where(F.col(key).isNotNull()).select(key, seq_col, *value_cols, F.xxhash64(*values).alias("_h"))
    if isinstance(batch.schema[seq_col].dataType, T.IntegralType):
        # sequence and hash as one fixed-width number, in their order (NULL first): one aggregate
        place = F.coalesce(F.col(seq_col).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
        packed = (place * F.lit(1 << 62).cast("decimal(19,0)") + F.shiftright("_h", 2).cast("decimal(19,0)")).cast("decimal(38,0)")
        ordered = hashed.withColumn("_o", packed)
        won = ordered.groupBy(F.col(key).alias("_k")).agg(pick("_o").alias("_w"))
        same = (F.col(key) == F.col("_k")) & (F.col("_o") == F.col("_w"))
        # partitioned by (key, order) already, so the repeats need no further shuffle
        return ordered.join(won.hint("shuffle_hash"), same, "left_semi").select(key, "_o", *value_cols).distinct().drop("_o")
    tops = hashed.groupBy(key, seq_col).agg(pick("_h").alias("_h"))
    end = pick(seq_col) if newest else F.when(F.count(seq_col) == F.count("*"), F.min(seq_col))  # NULL comes first
    last = tops.groupBy(F.col(key).alias("_k")).agg(end.alias("_s"))
    won = tops.join(last, (F.col(key) == F.col("_k")) & F.col(seq_col).eqNullSafe(F.col("_s")))
    won = won.select(F.col(key).alias("_k"), F.col(seq_col).alias("_s"), F.col("_h").alias("_w"))
    same = (F.col(key) == F.col("_k")) & F.col(seq_col).eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_w"))
    return hashed.join(won.hint("shuffle_hash"), same, "left_semi").select(key, *value_cols).distinct()


def upsert_last_wins(base: DataFrame, batch: DataFrame, key: str, seq_col: str) -> DataFrame:
    """K5: insert new keys, replace existing ones; within the batch the row with the
    highest ``seq_col`` wins (``INSERT ... ON CONFLICT DO UPDATE`` / point upsert). As in SQL, a
    NULL key never conflicts: rows without a key stay, and those of the batch are added."""
    values = [c for c in base.columns if c != key]
    latest = newest_rows(batch, key, seq_col, values)
    kept = base.join(batch.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    free = batch.where(F.col(key).isNull()).select(*base.columns)  # empty where the key is declared not null
    return kept.unionByName(latest.select(*base.columns)).unionByName(free)


def append_insert(base: DataFrame, batch: DataFrame) -> DataFrame:
    """K6: plain append, duplicates kept."""
    return base.unionByName(batch.select(*base.columns))


def insert_ignore(base: DataFrame, batch: DataFrame, key: str, seq_col: str) -> DataFrame:
    """K7: unordered keyed insert; keys already present are left alone and the first row of
    a key repeated inside the batch is the one inserted. A NULL key never conflicts: rows
    without one are added."""
    values = [c for c in base.columns if c != key]
    first = newest_rows(batch, key, seq_col, values, newest=False)
    new = first.join(base.select(key), key, "left_anti")
    free = batch.where(F.col(key).isNull()).select(*base.columns)
    return base.unionByName(new.select(*base.columns)).unionByName(free)


def insert_conflicts(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """K7: batch rows whose key already exists (what the store reports as write errors)."""
    return batch.join(base.select(key).distinct(), key, "left_semi")


def batch_plan(df: DataFrame, order_col: str, batch_size: int) -> DataFrame:
    """K8: request batches of ``batch_size`` rows in ``order_col`` order:
    ``(batch_id, rows, first_key, last_key)``."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    numbered = dense_ids(df.select(order_col), [order_col], [order_col], id_col="_row")
    b = numbered.withColumn("batch_id", F.floor(F.col("_row") / batch_size).cast("long"))
    return b.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order_col).alias("first_key"), F.max(order_col).alias("last_key")
    )


def truncate_keep_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """K9: an empty frame with the same schema (the collection is cleared, not dropped)."""
    return spark.createDataFrame([], df.schema)


def recreate_table(df: DataFrame, path: str) -> None:
    """K9: drop-and-create a stored collection from ``df`` (overwrite)."""
    df.write.mode("overwrite").parquet(path)


def validate_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, text_col: str | None = None) -> DataFrame:
    """The declared schema as checks: ``(id, reason)`` for every violation (NULL id,
    NULL text, NULL vector, wrong dimension, NULL/NaN element, duplicate key). Checks of a row are
    made where it is read; only ids are shuffled, counted beforehand. A NULL id is no duplicate."""
    checks = [
        F.when(F.col(id_col).isNull(), F.lit("null_id")),
        F.when(F.col(vec_col).isNull(), F.lit("null_embedding")),
        F.when(F.col(vec_col).isNotNull() & (F.size(vec_col) != dim), F.lit("wrong_dim")),
        F.when(F.col(vec_col).isNotNull() & has_bad_element(vec_col), F.lit("bad_element")),
    ]
    if text_col:
        checks.insert(1, F.when(F.col(text_col).isNull(), F.lit("null_text")))
    reasons = F.filter(F.array(*checks), lambda r: r.isNotNull())
    own = df.select(F.col(id_col).alias("id"), F.explode(reasons).alias("reason"))
    # one row for each row of a repeated key, made from its count: no vector or text meets its key
    counts = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = counts.select("id", "_n", F.explode(F.expr(f"sequence(0, (_n - 1) div {REPEAT_ROWS})")).alias("_part"))
    rows = parts.select("id", F.explode(F.expr(f"array_repeat('duplicate_key', cast(least({REPEAT_ROWS}, _n - _part * {REPEAT_ROWS}) as int))")).alias("reason"))
    return own.unionByName(rows)


def bound_payload(df: DataFrame, text_max: int = 1024, topic_max: int = 64) -> DataFrame:
    """``(text or '')[:1024]`` and ``(topic or '')[:64]``."""
    return df.withColumn("text", F.substring(F.coalesce(F.col("text"), F.lit("")), 1, text_max)).withColumn(
        "topic", F.substring(F.coalesce(F.col("topic"), F.lit("")), 1, topic_max)
    )


def stack_optional(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by name; a column missing in one frame is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def coerce_vectors(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Ids as BIGINT, vectors as ARRAY<FLOAT>."""
    return df.withColumn(id_col, F.col(id_col).cast("long")).withColumn(vec_col, F.col(vec_col).cast("array<float>"))
