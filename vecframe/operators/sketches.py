"""A2 from stored quantile sketches.

Every run of the log keeps one mergeable KLL sketch with its count, sum and range, so that a
summary over stores, weeks or the whole log merges a few kilobytes a run and never reads the
log again. Sketches are built by a grouped aggregate with partial (map-side) sketches: a hot
run moves one small sketch per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.operators.metrics import LATENCY_PROBS, _pcol
from vecframe.operators.ranking import join_null_safe

SKETCH_K = 1024


def rank_bound(k: int = SKETCH_K) -> float:
    """Bound of a quantile's rank error as a share of the rows: twice the one that KLL's
    authors give at 99 % confidence, merged sketches included."""
    return 2 * 2.296 / k**0.9021


def _real(value_col: str) -> Column:
    value = F.col(value_col).cast("double")
    return F.when(~F.isnan(value), value)


def run_sketches(log: DataFrame, run_cols: Sequence[str], value_col: str, k: int = SKETCH_K) -> DataFrame:
    """``(run..., sketch, n, total, least, most)``, one row per run. Null and NaN values are
    not counted; a run without any other value has n = 0; null keys are a run of their own."""
    value = _real(value_col)
    return log.groupBy(*run_cols).agg(
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count(value).alias("n"),
        F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def save_sketches(runs: DataFrame, path: str, by: str) -> None:
    """Adds runs to the stored ones. The values of ``by`` (a week, say) that occur in ``runs``
    replace what is stored for them, so a repeated write changes nothing; others stay."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_sketches(runs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Stored runs merged over coarser groups (none: everything), in the same columns."""
    return runs.where("n > 0").groupBy(*group_cols).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    ).where("n > 0")


def sketch_summary(sketches: DataFrame, group_cols: Sequence[str], probs: Sequence[float] = LATENCY_PROBS) -> DataFrame:
    """``(group..., n, avg_ms, min_ms, max_ms, p50_ms, ...)``: all but the percentiles exact,
    those within :func:`rank_bound`; nulls where a group has no values."""
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs])))
    return sketches.withColumn("_q", found).select(
        *group_cols, "n", F.try_divide("total", "n").alias("avg_ms"), F.col("least").alias("min_ms"), F.col("most").alias("max_ms"),
        *[F.col("_q")[i].alias(_pcol(p)) for i, p in enumerate(probs)],
    )


def rank_errors(log: DataFrame, summary: DataFrame, group_cols: Sequence[str], value_col: str,
                probs: Sequence[float] = LATENCY_PROBS) -> DataFrame:
    """``(group..., n, err_p50, ...)``: how far each percentile's ranks in the log (all those
    of equal values) are from the wanted one, as a share of the group's rows."""
    value, names = F.col("_value"), [_pcol(p) for p in probs]
    rows = log.select(*group_cols, _real(value_col).alias("_value")).where(value.isNotNull())
    found = summary.select(*group_cols, *names)
    met = join_null_safe(rows, found, list(group_cols)) if group_cols else rows.crossJoin(F.broadcast(found))  # one row
    n = F.count(value)
    errors = []
    for p, c in zip(probs, names, strict=True):
        below, upto = F.count_if(value < F.col(c)) / n, F.count_if(value <= F.col(c)) / n
        errors.append(F.greatest(F.lit(0.0), below - p, p - upto).alias(f"err_{c.removesuffix('_ms')}"))
    return met.groupBy(*group_cols).agg(n.alias("n"), *errors)


def sketch_rollup(log: DataFrame, runs: DataFrame, levels: dict[str, Sequence[str]], key_types: dict[str, str], value_col: str,
                  k: int = SKETCH_K, probs: Sequence[float] = LATENCY_PROBS) -> DataFrame:
    """Every level's summary from the stored ``runs``, each percentile with whether its rank
    error, measured on the log, is within the bound."""
    parts = []
    for level, cols in levels.items():
        summary = sketch_summary(merge_sketches(runs, cols), cols, probs)
        errors = rank_errors(log, summary, cols, value_col, probs).drop("n")
        both = join_null_safe(summary, errors, list(cols)) if cols else summary.crossJoin(F.broadcast(errors))  # one row each
        parts.append(both.select(
            F.lit(level).alias("level"), *[(F.col(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in key_types.items()],
            "n", "avg_ms", "min_ms", "max_ms",
            *[(F.col(f"err_{_pcol(p).removesuffix('_ms')}") <= rank_bound(k)).alias(f"{_pcol(p).removesuffix('_ms')}_within") for p in probs],
        ))
    return reduce(DataFrame.unionByName, parts)
