"""Positions inside ordered groups without sending a group to one task.

``row_number() OVER (PARTITION BY g ORDER BY v)`` puts a whole group into one task; with
a hot group (a third of all rows) that task holds a third of the data. Here the rows are
range-partitioned on ``(g, v, tiebreak)`` instead, so a hot group is spread over many
range partitions. Inside a partition the row index comes from
``monotonically_increasing_id()`` (its low 33 bits count rows of the partition), and the
offset of every (partition, group) piece comes from a small statistics frame with one row
per piece. Positions are exact and 0-based.

This serves dense ids (P5), batch numbers (K8), exact linear percentiles (A1, A2) and
lower-nearest-rank percentiles (A3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecframe.session import cut_lineage

_LOW33 = (1 << 33) - 1


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL (a NULL group is a group like any
    other); the keys come once, then the other columns of both sides."""
    named = {k: f"__{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    cond = F.lit(True)
    for k, o in named.items():
        cond = cond & F.col(k).eqNullSafe(F.col(o))
    out = left.join(other, cond, how)
    if how == "full":  # a row of one side only has its key there
        out = out.withColumns({k: F.coalesce(k, o) for k, o in named.items()})
    return out.drop(*named.values())


def _maybe_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def with_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    tiebreak: Sequence[str],
    *,
    pos_col: str = "pos",
    total_col: str | None = "group_rows",
    partitions: int | None = None,
    groups_bounded: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row inside its group (ordered by ``order_cols``
    then ``tiebreak``) and, optionally, the group size.

    ``tiebreak`` must make the order total (a unique key); it also lets the range
    partitioner split a group whose values are all equal. ``groups_bounded`` states that
    the number of groups is small by construction, so the statistics are broadcast.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [*[F.col(g) for g in group_cols], *order, *[F.col(t) for t in tiebreak]]
    s = (
        df.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))
    )
    # The pieces statistics and the rows must see the very same range partitions. Two
    # range exchanges would each sample their own bounds, so (_pid, _mid) are written
    # once to the shared checkpoint folder and both branches read them back. This also
    # cuts the lineage, so a lost executor never re-derives different partitions.
    s = cut_lineage(s)
    g = list(group_cols)
    pieces = s.groupBy("_pid", *g).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total_col:
        pieces = pieces.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*g)))
    out = join_null_safe(s, _maybe_broadcast(pieces, groups_bounded), ["_pid", *g])
    out = out.withColumn(pos_col, F.col("_off") + F.col("_mid") - F.col("_first"))
    return out.drop("_pid", "_mid", "_first", "_n", "_off")


def dense_ids(df: DataFrame, order_cols: Sequence[str], tiebreak: Sequence[str] = (), id_col: str = "id",
              start: int = 0) -> DataFrame:
    """Consecutive ids in the order of ``order_cols`` over the whole frame (P5)."""
    tb = list(tiebreak) or list(order_cols)
    tmp = df.withColumn("_one", F.lit(0))
    out = with_positions(tmp, ["_one"], list(order_cols), tb, pos_col=id_col, total_col=None, groups_bounded=True)
    return out.withColumn(id_col, F.col(id_col) + F.lit(start)).drop("_one")


def group_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    tiebreak: Sequence[str],
    probs: Sequence[float],
    *,
    rule: str = "linear",
    groups_bounded: bool = False,
) -> DataFrame:
    """Exact per-group quantiles, one row per (group, p) with columns ``p, value``.

    ``rule='linear'`` interpolates at ``p*(n-1)`` (like ``percentile`` / ``quantile_cont``);
    ``rule='lower'`` takes the element at ``floor(p*(n-1))`` (lower nearest rank). NULL
    values are ignored; an empty group yields no row.
    """
    if rule not in ("linear", "lower"):
        raise ValueError("rule must be 'linear' or 'lower'")
    g = list(group_cols)
    src = df.filter(F.col(value_col).isNotNull()).select(*g, value_col, *tiebreak)
    pos = with_positions(src, g, [value_col], tiebreak, total_col=None, groups_bounded=groups_bounded)
    sizes = src.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    plist = F.array(*[F.lit(float(p)) for p in probs])
    targets = (
        sizes.select(*g, "_n", F.explode(plist).alias("p"))
        .withColumn("_idx", F.col("p") * (F.col("_n") - 1))
        .withColumn("_lo", F.floor("_idx"))
        .withColumn("_hi", F.ceil("_idx") if rule == "linear" else F.floor("_idx"))
        .withColumn("_frac", F.col("_idx") - F.col("_lo"))
    )
    wanted = targets.select(*g, "p", "_lo", "_hi", "_frac", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("pos"))
    picked = join_null_safe(pos.select(*g, "pos", value_col), _maybe_broadcast(wanted, groups_bounded), [*g, "pos"])
    agg = picked.groupBy(*g, "p").agg(
        F.max(F.when(F.col("pos") == F.col("_lo"), F.col(value_col))).alias("_vlo"),
        F.max(F.when(F.col("pos") == F.col("_hi"), F.col(value_col))).alias("_vhi"),
        F.first("_frac").alias("_frac"),
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
    )
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_vlo")).otherwise(
        F.col("_vlo") * (1 - F.col("_frac")) + F.col("_vhi") * F.col("_frac")
    )
    return agg.select(*g, "p", value.cast("double").alias("value"))
