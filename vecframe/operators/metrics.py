"""Evaluation operators (A1-A15): latency summaries, Recall@K, throughput, run records.

Every summary is a grouped aggregation with partial (map-side) aggregation. The exact
percentiles use :mod:`vecframe.operators.ranking` so that a hot group is spread over many
tasks; ``latency_summary_approx`` offers the bounded-memory sketch for very large logs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.functions.temporal import epoch_micros
from vecframe.operators.ranking import group_quantiles, join_null_safe, with_positions

LATENCY_PROBS = (0.5, 0.95, 0.99)


def _pcol(p: float) -> str:
    return f"p{int(round(p * 100))}_ms"


def percentiles(log: DataFrame, group_cols: Sequence[str], value_col: str, tiebreak: Sequence[str],
                probs: Sequence[float], rule: str = "linear", groups_bounded: bool = False) -> DataFrame:
    """A1: exact percentiles per group, long form ``(group..., p, value)``."""
    return group_quantiles(log, group_cols, value_col, tiebreak, probs, rule=rule, groups_bounded=groups_bounded)


def latency_summary(log: DataFrame, group_cols: Sequence[str], value_col: str, tiebreak: Sequence[str],
                    groups_bounded: bool = False) -> DataFrame:
    """A2: ``avg_ms, p50_ms, p95_ms, p99_ms, n`` per group (linear interpolation)."""
    g = list(group_cols)
    q = group_quantiles(log, g, value_col, tiebreak, LATENCY_PROBS, groups_bounded=groups_bounded)
    wide = q.groupBy(*g).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(_pcol(p)) for p in LATENCY_PROBS])
    basic = log.groupBy(*g).agg(
        F.avg(value_col).alias("avg_ms"), F.count(value_col).alias("n")
    )
    return join_null_safe(basic, wide, g, "left").select(*g, "avg_ms", *[_pcol(p) for p in LATENCY_PROBS], "n")


def latency_summary_approx(log: DataFrame, group_cols: Sequence[str], value_col: str, accuracy: int = 10000) -> DataFrame:
    """A2 at any scale: percentiles from the bounded-memory quantile sketch."""
    g = list(group_cols)
    ps = F.percentile_approx(value_col, list(LATENCY_PROBS), accuracy)
    return log.groupBy(*g).agg(F.avg(value_col).alias("avg_ms"), ps.alias("_ps"), F.count(value_col).alias("n")).select(
        *g, "avg_ms", *[F.col("_ps")[i].alias(_pcol(p)) for i, p in enumerate(LATENCY_PROBS)], "n"
    )


def latency_lower_rank(log: DataFrame, group_cols: Sequence[str], value_col: str, tiebreak: Sequence[str],
                       groups_bounded: bool = False) -> DataFrame:
    """A3: the repeat-search summary: ``avg_ms``, ``p50_ms`` and ``p95_ms`` taken as the
    element at ``floor(p*(n-1))`` of the sorted times, and ``repeats``."""
    g = list(group_cols)
    q = group_quantiles(log, g, value_col, tiebreak, (0.5, 0.95), rule="lower", groups_bounded=groups_bounded)
    wide = q.groupBy(*g).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50_ms"),
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95_ms"),
    )
    basic = log.groupBy(*g).agg(F.avg(value_col).alias("avg_ms"), F.count(value_col).alias("repeats"))
    return join_null_safe(basic, wide, g, "left").select(*g, "avg_ms", "p50_ms", "p95_ms", "repeats")


# ------------------------------------------------------------------ recall

def recall_per_query(pred: DataFrame, truth: DataFrame, k: int, query_col: str | Sequence[str] = "query_id", id_col: str = "id",
                     rank_col: str = "rank") -> DataFrame:
    """A4: |pred ∩ truth| / |truth| over the top-k id sets of each query.

    Duplicated ids collapse (set semantics); a query with an empty truth or an empty
    prediction list scores 0.0. Queries present on either side are reported; NULL equals
    nothing. Both sides meet in one exchange on the query, which may have several columns.
    """
    q = [query_col] if isinstance(query_col, str) else list(query_col)
    unknown = reduce(or_, [F.col(c).isNull() for c in q])
    sides = [
        side.filter(F.col(rank_col) <= k).select(*q, id_col, F.lit(name).alias("_side"))
        .withColumn("_apart", F.when(unknown, F.col("_side")))
        for name, side in (("t", truth), ("p", pred))
    ]
    key = [*q, "_apart"]
    both = sides[0].unionByName(sides[1]).repartition(*key).groupBy(*key, id_col).agg(
        F.max((F.col("_side") == "t").cast("long")).alias("_t"), F.max((F.col("_side") == "p").cast("long")).alias("_p"))
    found = F.when(F.col(id_col).isNotNull(), F.col("_t") * F.col("_p"))
    sums = both.groupBy(*key).agg(F.sum("_t").alias("truth_n"), F.sum("_p").alias("pred_n"), F.coalesce(F.sum(found), F.lit(0)).alias("found"))
    recall = F.when((F.col("truth_n") == 0) | (F.col("pred_n") == 0), F.lit(0.0)).otherwise(F.col("found") / F.col("truth_n"))
    return sums.select(*q, recall.cast("double").alias("recall"))


def recall_summary(per_query: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A5: mean recall, population std (0.0 for one query) and query count."""
    g = list(group_cols)
    agg = [
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_k"),
        F.when(F.count("recall") > 1, F.stddev_pop("recall")).otherwise(F.lit(0.0)).alias("recall_std"),
        F.count("recall").alias("n_queries"),
    ]
    return per_query.groupBy(*g).agg(*agg) if g else per_query.agg(*agg)


def recall_alignment(pred: DataFrame, truth: DataFrame, query_col: str = "query_id") -> DataFrame:
    """The query sets of predictions and truth must match; one row with the counts of
    queries present on one side only (the reference raises when they differ)."""
    pq = pred.select(query_col).distinct().withColumn("_p", F.lit(1))
    tq = truth.select(query_col).distinct().withColumn("_t", F.lit(1))
    both = pq.join(tq, query_col, "full")
    out = both.agg(
        F.count("_p").alias("pred_queries"),
        F.count("_t").alias("truth_queries"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("only_pred"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("only_truth"),
    )
    return out.withColumn("aligned", (F.col("only_pred") == 0) & (F.col("only_truth") == 0))


def assert_aligned(pred: DataFrame, truth: DataFrame, query_col: str = "query_id") -> None:
    row = recall_alignment(pred, truth, query_col).first()
    if not row["aligned"]:
        raise ValueError(f"{row['only_pred']} queries have predictions only and {row['only_truth']} ground truth only")


# ------------------------------------------------------------------ throughput

def throughput_summary(log: DataFrame, group_cols: Sequence[str], ts_col: str) -> DataFrame:
    """``total_queries``, ``duration_s`` (first to last request) and
    ``qps = total_queries / duration_s`` (0 when the duration is 0)."""
    g = list(group_cols)
    dur = (F.max(epoch_micros(ts_col)) - F.min(epoch_micros(ts_col))) / F.lit(1_000_000.0)
    out = log.groupBy(*g).agg(F.count(F.lit(1)).alias("total_queries"), dur.alias("duration_s"))
    qps = F.when(F.col("duration_s") > 0, F.col("total_queries") / F.col("duration_s")).otherwise(F.lit(0.0))
    return out.select(*g, qps.alias("qps"), "total_queries", "duration_s")


def throughput_windows(log: DataFrame, group_cols: Sequence[str], ts_col: str, duration: str = "1 hour") -> DataFrame:
    """Requests completed per fixed (tumbling) time window."""
    g = list(group_cols)
    w = F.window(ts_col, duration)
    return log.groupBy(*g, w.alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(
        *g, (epoch_micros(F.col("w.start")) / 1_000_000).cast("long").alias("window_start_s"), "requests"
    )


def round_robin_assign(log: DataFrame, group_cols: Sequence[str], order_col: str, tiebreak: Sequence[str],
                       queries: DataFrame, query_col: str = "query_id") -> DataFrame:
    """The i-th request of a group (in ``order_col`` order) uses query ``i mod n``,
    where queries are numbered densely in ``query_col`` order."""
    numbered = with_positions(queries.select(query_col).withColumn("_all", F.lit(0)), ["_all"], [query_col], [query_col],
                              pos_col="_qpos", total_col="_nq", groups_bounded=True).drop("_all")
    n_queries = queries.count()
    if n_queries == 0:
        raise ValueError("round robin needs at least one query")
    seq = with_positions(log, group_cols, [order_col], tiebreak, pos_col="seq", total_col=None)
    seq = seq.withColumn("_qpos", F.pmod(F.col("seq"), F.lit(n_queries)))
    return seq.join(numbered.select("_qpos", query_col), "_qpos").drop("_qpos")


# ------------------------------------------------------------------ run records

def metric_record(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge per-run aggregates (latency, throughput, recall, insert, memory) into one
    record per run. Every part has one row per key, so the joins are one-to-one."""
    out = parts[0]
    for p in parts[1:]:
        out = join_null_safe(out, p, list(keys), "full")
    return out


def insert_speed(runs: DataFrame) -> DataFrame:
    """``insert_s`` and ``vectors_per_s``."""
    insert_s = F.col("insert_ms") / 1000.0
    return runs.select("db", "n_dataset", insert_s.alias("insert_s"),
                       F.try_divide(F.col("insert_count").cast("double"), insert_s).alias("vectors_per_s"))


def total_time(runs: DataFrame) -> DataFrame:
    """Approximate run time = insert + average latency x searches + throughput window."""
    t = F.col("insert_ms") / 1000.0 + F.col("avg_ms") * F.col("n") / 1000.0 + F.col("duration_s")
    return runs.select("db", "n_dataset", t.alias("approx_total_s"))


def metric_checks(runs: DataFrame, qps_tolerance: float = 0.5) -> DataFrame:
    """Documented sanity rules, one row per (run, check)."""
    checks = F.array(
        F.struct(F.lit("p50_le_p95").alias("check"), (F.col("p50_ms") <= F.col("p95_ms")).alias("ok")),
        F.struct(F.lit("p95_le_p99").alias("check"), (F.col("p95_ms") <= F.col("p99_ms")).alias("ok")),
        F.struct(F.lit("insert_count_eq_n").alias("check"), (F.col("insert_count") == F.col("n")).alias("ok")),
        F.struct(
            F.lit("qps_near_inverse_latency").alias("check"),
            (F.abs(F.col("qps") - F.try_divide(F.lit(1000.0), F.col("avg_ms")))
             <= F.lit(qps_tolerance) * F.try_divide(F.lit(1000.0), F.col("avg_ms"))).alias("ok"),
        ),
    )
    return runs.select("db", "n_dataset", F.explode(checks).alias("c")).select("db", "n_dataset", "c.check", "c.ok")


def dir_usage_mb(spark, path: str) -> float | None:
    """Total size of the files under ``path`` in MB (recursive). Only the ``length``
    column of the ``binaryFile`` source is read, so file contents are never loaded; a
    missing or unreadable folder gives ``None`` (the reference's NaN)."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("ignoreCorruptFiles", "true").load(path))
        total = files.agg(F.sum("length").alias("b")).first()["b"]
    except Exception:  # noqa: BLE001 - the reference reports NaN for any failure
        return None
    return (total or 0) / (1024 * 1024)
