"""Reporting operators (R1-R16): the data behind the reference's tables and charts.

A run table has one row per (store, size); every operator here is a grouped aggregation,
a join against one-row-per-key aggregates, or a window over a (store, metric) series whose
length is the number of sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.functions.text import fmt

SERIES_METRICS = ["p50_ms", "p95_ms", "p99_ms", "avg_ms", "insert_ms", "qps", "memory_mb", "recall_at_k", "recall_std"]
# metric -> True when lower is better (the radar / heat-map / leaderboard metrics)
SCORE_METRICS = {"p50_ms": True, "p95_ms": True, "insert_ms": True, "qps": False, "memory_mb": True, "recall_at_k": False}


def unpivot_metrics(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("db", "n_dataset")) -> DataFrame:
    """Long form ``(*keys, metric, value)``; metrics absent from the table are skipped."""
    present = [m for m in metrics if m in runs.columns]
    cols = runs.select(*keys, *[F.col(m).cast("double").alias(m) for m in present])
    return cols.unpivot(list(keys), present, "metric", "value")


def suite_table(frames: Sequence[DataFrame]) -> DataFrame:
    """R1+R2: per-store records stacked by name (a missing optional column is NULL),
    sorted by (n_dataset, db)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy("n_dataset", "db")


def bar_values(runs: DataFrame, metrics: Sequence[str] = SERIES_METRICS) -> DataFrame:
    """One bar per store and metric of the largest size; a missing value is drawn as 0."""
    long = unpivot_metrics(first_per_db(largest_slice(runs)), metrics, keys=("db",))
    return long.select("db", "metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def distinct_axes(runs: DataFrame) -> DataFrame:
    """Sorted distinct store names and sizes: ``(axis, pos, value)``."""
    dbs = runs.select(F.lit("db").alias("axis"), F.col("db").alias("value"), F.col("db").alias("_k"),
                      F.lit(None).cast("long").alias("_n")).distinct()
    ns = runs.select(F.lit("n_dataset").alias("axis"), F.col("n_dataset").cast("string").alias("value"),
                     F.lit(None).cast("string").alias("_k"), F.col("n_dataset").alias("_n")).distinct()
    both = dbs.unionByName(ns)
    w = Window.partitionBy("axis").orderBy("_n", "_k")  # one group per axis, distinct values only
    return both.select("axis", (F.row_number().over(w) - 1).alias("pos"), "value")


def metric_series(runs: DataFrame, metrics: Sequence[str] = SERIES_METRICS) -> DataFrame:
    """Per (store, metric) the points ordered by size: ``(db, metric, point, n_dataset, value)``."""
    long = unpivot_metrics(runs, metrics)
    w = Window.partitionBy("db", "metric").orderBy("n_dataset")
    return long.select("db", "metric", (F.row_number().over(w) - 1).alias("point"), "n_dataset", "value")


def largest_slice(runs: DataFrame) -> DataFrame:
    """The runs of the largest size (equi-join with the one-row maximum)."""
    top = runs.agg(F.max("n_dataset").alias("n_dataset"))
    return runs.join(F.broadcast(top), "n_dataset").select(*runs.columns)


def first_per_db(runs: DataFrame, order_col: str = "n_dataset") -> DataFrame:
    """First record per store (``iloc[0]``): ``min_by`` over the record, no window."""
    cols = [c for c in runs.columns if c != "db"]
    return runs.groupBy("db").agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r")).select(
        "db", *[F.col(f"_r.{c}").alias(c) for c in cols]
    )


def summary_latency(runs: DataFrame) -> DataFrame:
    """Latency table of the largest size."""
    s = first_per_db(largest_slice(runs))
    return s.select(F.upper("db").alias("database"), fmt("p50_ms", "%.2f").alias("p50_ms"),
                    fmt("p95_ms", "%.2f").alias("p95_ms"), fmt("p99_ms", "%.2f").alias("p99_ms"),
                    fmt("avg_ms", "%.2f").alias("avg_ms"))


def summary_throughput(runs: DataFrame) -> DataFrame:
    """Insert time, throughput and memory of the largest size; missing -> N/A."""
    s = first_per_db(largest_slice(runs))
    return s.select(F.upper("db").alias("database"), fmt("insert_ms", "%.0f").alias("insert_time_ms"),
                    fmt("qps", "%.0f").alias("throughput_qps"), fmt("memory_mb", "%.1f").alias("memory_mb"))


def summary_accuracy(runs: DataFrame) -> DataFrame:
    """Recall, its std and the query count of the largest size."""
    s = first_per_db(largest_slice(runs))
    return s.select(F.upper("db").alias("database"), fmt("recall_at_k", "%.3f").alias("recall_at_k"),
                    fmt("recall_std", "%.3f").alias("std_dev"),
                    F.coalesce(F.col("n_queries").cast("string"), F.lit("N/A")).alias("n_queries"))


def summary_all(runs: DataFrame) -> DataFrame:
    """The seven-column comprehensive table of the largest size."""
    s = first_per_db(largest_slice(runs))
    return s.select(F.upper("db").alias("database"), fmt("insert_ms", "%.0f").alias("insert_ms"),
                    fmt("p50_ms", "%.2f").alias("p50_ms"), fmt("p95_ms", "%.2f").alias("p95_ms"),
                    fmt("qps", "%.0f").alias("qps"), fmt("memory_mb", "%.1f").alias("memory_mb"),
                    fmt("recall_at_k", "%.3f").alias("recall_at_k"))


def normalized_scores(runs: DataFrame, metrics: dict[str, bool] = SCORE_METRICS, drop_all_null: bool = False) -> DataFrame:
    """Min-max scores in [0, 1] per metric over the largest size, higher = better.

    Lower-is-better metrics are inverted; a constant metric scores 0.5; a missing value
    scores 0.5; min/max skip NULLs. With ``drop_all_null`` a metric without any value is
    left out (heat map), otherwise it scores 0.5 everywhere (radar)."""
    s = first_per_db(largest_slice(runs))
    long = unpivot_metrics(s, list(metrics), keys=("db",))
    lower = F.create_map(*[x for m, lo in metrics.items() for x in (F.lit(m), F.lit(lo))])
    bounds = long.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"),
                                        F.count("value").alias("_n"))
    j = long.join(F.broadcast(bounds), "metric")
    if drop_all_null:
        j = j.filter(F.col("_n") > 0)
    frac = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    raw = F.when(F.col("value").isNull(), F.lit(0.5)).when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(
        F.when(lower[F.col("metric")], 1 - frac).otherwise(frac)
    )
    return j.select("db", "metric", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("score"))


def heatmap_matrix(runs: DataFrame, metrics: dict[str, bool] = SCORE_METRICS) -> DataFrame:
    """Metric x store matrix of normalised scores (rows = metrics, one column per
    store, stores sorted). Store names are a handful of report labels."""
    scores = normalized_scores(runs, metrics, drop_all_null=True)
    limit = int(runs.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    names = sorted(r["db"] for r in runs.select("db").distinct().limit(limit + 1).collect())
    if len(names) > limit:
        raise ValueError(f"more than {limit} stores: too many heat-map columns")
    return scores.groupBy("metric").pivot("db", names).agg(F.first("score"))


def leaderboard(runs: DataFrame, metrics: dict[str, bool] = SCORE_METRICS, places: int = 2) -> DataFrame:
    """Winner and runner-up per category of the largest size, direction-aware."""
    s = first_per_db(largest_slice(runs))
    long = unpivot_metrics(s, list(metrics), keys=("db",)).filter(F.col("value").isNotNull())
    lower = F.create_map(*[x for m, lo in metrics.items() for x in (F.lit(m), F.lit(lo))])
    signed = F.when(lower[F.col("metric")], F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(signed, F.col("db"))  # one row per store in a category
    return long.select(F.col("metric").alias("category"), F.row_number().over(w).alias("place"), "db", "value").filter(
        F.col("place") <= places
    )


def scaling_ratio(runs: DataFrame, metrics: Sequence[str] = ("p50_ms", "qps")) -> DataFrame:
    """Each metric against the previous size of the same store."""
    long = unpivot_metrics(runs, metrics)
    w = Window.partitionBy("db", "metric").orderBy("n_dataset")
    prev = F.lag("value").over(w)
    return long.select("db", "metric", "n_dataset", "value", prev.alias("prev_value")).withColumn(
        "ratio", F.try_divide(F.col("value"), F.col("prev_value"))
    )


def scaling_slope(runs: DataFrame, metrics: Sequence[str] = ("p50_ms", "p95_ms", "qps")) -> DataFrame:
    """How a metric of a store grows with size: the least-squares slope of ln(metric) on
    ln(size), which is the exponent of a power law, with its standard error and the share of
    the variance it explains. Points whose size or metric is not positive have no logarithm and
    take no part; NULL where the points do not determine a value (one size; two points for the
    error)."""
    long = unpivot_metrics(runs, metrics).where((F.col("value") > 0) & (F.col("n_dataset") > 0))
    p = long.select("db", "metric", F.log("value").alias("y"), F.log(F.col("n_dataset").cast("double")).alias("x"))
    s = p.groupBy("db", "metric").agg(
        F.count("*").alias("points"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"),
    )
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))  # unexplained
    sloped = F.col("_sxx") > 0
    return s.select(
        "db", "metric", "points", F.when(sloped, F.col("slope")).alias("slope"), F.when(sloped, F.col("intercept")).alias("intercept"),
        F.when(sloped & (F.col("points") > 2), F.sqrt(rest / (F.col("points") - 2) / F.col("_sxx"))).alias("slope_error"),
        F.when(sloped & (F.col("_syy") > 0), 1 - rest / F.col("_syy")).alias("r2"),
    )


def pareto_front(runs: DataFrame, x: str = "recall_at_k", y: str = "qps", group: str = "n_dataset") -> DataFrame:
    """Runs of each size that no other run of that size beats on both ``x`` and ``y``.

    No pairs are formed: a run is on the front iff its ``y`` is the best ``y`` among runs
    with the same ``x`` and is above every ``y`` reached with a strictly larger ``x``. The
    per-x maxima are a grouped aggregate; the running maximum walks the distinct x values
    of a size in descending order."""
    best = runs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, x).agg(F.max(y).alias("_ybest"))
    above = Window.partitionBy(group).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_yabove", F.max("_ybest").over(above))
    j = runs.select(group, "db", x, y).join(best, [group, x])
    keep = (F.col(y) == F.col("_ybest")) & (F.col("_yabove").isNull() | (F.col(y) > F.col("_yabove")))
    return j.filter(keep).select(group, "db", x, y)
