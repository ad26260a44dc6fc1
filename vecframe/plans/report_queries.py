"""Registered report queries (R1-R16, K1) over the run table derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecframe.operators import reports as R
from vecframe.plans.eval_queries import RUNS_CTE, runs
from vecframe.plans.registry import register
from vecframe.sources.sinks import report_rows


def _unpivot_sql(src: str, metrics, keys=("db", "n_dataset")) -> str:
    k = ", ".join(keys)
    return "\n  UNION ALL ".join(f"SELECT {k}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}" for m in metrics)


_LARGEST = "big AS (SELECT * FROM runs WHERE n_dataset = (SELECT max(n_dataset) FROM runs))"
_LOWER = "CASE metric " + " ".join(f"WHEN '{m}' THEN {str(lo).upper()}" for m, lo in R.SCORE_METRICS.items()) + " END"


def stacked(spark, sf_dir):
    """The records of every store, stacked whole."""
    record = runs(spark, sf_dir)
    view = F.col("db").eqNullSafe("view")  # a run without a store is a record, too
    return R.suite_table([record.where(~view), record.where(view)])


@register("suite_table", f"WITH {RUNS_CTE} SELECT * FROM runs")
def suite_table(spark, sf_dir):
    """R1+R2: the records of several stores stacked by name, sorted by (n_dataset, db)."""
    return stacked(spark, sf_dir)


@register("bar_values", f"""WITH {RUNS_CTE}, {_LARGEST},
l AS ({_unpivot_sql("big", R.SERIES_METRICS, keys=("db",))})
SELECT db, metric, coalesce(value, 0.0) AS value FROM l""")
def bar_values(spark, sf_dir):
    """Bars of the largest size, missing values as 0."""
    return R.bar_values(stacked(spark, sf_dir))


@register("distinct_axes", f"""WITH {RUNS_CTE},
a AS (SELECT DISTINCT 'db' AS axis, db AS value, db AS k, NULL::BIGINT AS n FROM runs
      UNION ALL
      SELECT DISTINCT 'n_dataset', CAST(n_dataset AS VARCHAR), NULL::VARCHAR, n_dataset FROM runs)
SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY n, k) - 1 AS pos, value FROM a""")
def distinct_axes(spark, sf_dir):
    """Sorted distinct sizes and store names."""
    return R.distinct_axes(runs(spark, sf_dir))


@register("metric_series", f"""WITH {RUNS_CTE},
l AS ({_unpivot_sql("runs", R.SERIES_METRICS)})
SELECT db, metric, row_number() OVER (PARTITION BY db, metric ORDER BY n_dataset) - 1 AS point, n_dataset, value FROM l""")
def metric_series(spark, sf_dir):
    """Chart series per store and metric, ordered by size."""
    return R.metric_series(runs(spark, sf_dir))


@register("largest_slice", f"WITH {RUNS_CTE}, {_LARGEST} SELECT * FROM big")
def largest_slice(spark, sf_dir):
    """Records of the largest size."""
    return R.largest_slice(runs(spark, sf_dir))


@register("summary_table_latency", f"""WITH {RUNS_CTE}, {_LARGEST}
SELECT upper(db) AS database, printf('%.2f', p50_ms) AS p50_ms, printf('%.2f', p95_ms) AS p95_ms,
       printf('%.2f', p99_ms) AS p99_ms, printf('%.2f', avg_ms) AS avg_ms FROM big""")
def summary_table_latency(spark, sf_dir):
    """R7 (+P13, R6): latency table."""
    return R.summary_latency(runs(spark, sf_dir))


@register("summary_table_throughput", f"""WITH {RUNS_CTE}, {_LARGEST}
SELECT upper(db) AS database, printf('%.0f', insert_ms) AS insert_time_ms,
       coalesce(printf('%.0f', qps), 'N/A') AS throughput_qps,
       coalesce(printf('%.1f', memory_mb), 'N/A') AS memory_mb FROM big""")
def summary_table_throughput(spark, sf_dir):
    """Insert / throughput / memory table with N/A for missing values."""
    return R.summary_throughput(runs(spark, sf_dir))


@register("summary_table_accuracy", f"""WITH {RUNS_CTE}, {_LARGEST}
SELECT upper(db) AS database, printf('%.3f', recall_at_k) AS recall_at_k, printf('%.3f', recall_std) AS std_dev,
       CAST(n_queries AS VARCHAR) AS n_queries FROM big""")
def summary_table_accuracy(spark, sf_dir):
    """Accuracy table."""
    return R.summary_accuracy(runs(spark, sf_dir))


@register("summary_table_all", f"""WITH {RUNS_CTE}, {_LARGEST}
SELECT upper(db) AS database, printf('%.0f', insert_ms) AS insert_ms, printf('%.2f', p50_ms) AS p50_ms,
       printf('%.2f', p95_ms) AS p95_ms, printf('%.0f', qps) AS qps, printf('%.1f', memory_mb) AS memory_mb,
       printf('%.3f', recall_at_k) AS recall_at_k FROM big""")
def summary_table_all(spark, sf_dir):
    """The comprehensive seven-column table."""
    return R.summary_all(runs(spark, sf_dir))


_SCORES = f"""{_LARGEST},
l AS ({_unpivot_sql("big", list(R.SCORE_METRICS), keys=("db",))}),
b AS (SELECT metric, min(value) AS lo, max(value) AS hi, count(value) AS n FROM l GROUP BY metric),
sc AS (
  SELECT l.db, l.metric, b.n,
         greatest(0.0, least(1.0,
           CASE WHEN l.value IS NULL THEN 0.5 WHEN b.hi = b.lo THEN 0.5
                WHEN {_LOWER.replace("metric", "l.metric")} THEN 1 - (l.value - b.lo) / (b.hi - b.lo)
                ELSE (l.value - b.lo) / (b.hi - b.lo) END)) AS score
  FROM l JOIN b ON l.metric = b.metric)"""


@register("radar_scores", f"WITH {RUNS_CTE}, {_SCORES} SELECT db, metric, score FROM sc")
def radar_scores(spark, sf_dir):
    """Min-max normalised scores (higher = better) for six metrics."""
    return R.normalized_scores(runs(spark, sf_dir))


# the event types of the test tables; the Spark side takes the stores from the data
_STORES = ", ".join(f"max(score) FILTER (WHERE db = '{s}') AS \"{s}\"" for s in ("click", "error", "purchase", "signup", "view"))


@register("heatmap_matrix", f"""WITH {RUNS_CTE}, {_SCORES}
SELECT metric, {_STORES} FROM sc WHERE n > 0 GROUP BY metric""")
def heatmap_matrix(spark, sf_dir):
    """Metric x store matrix; all-null metrics dropped, other NULLs 0.5."""
    return R.heatmap_matrix(runs(spark, sf_dir))


@register("leaderboard", f"""WITH {RUNS_CTE}, {_LARGEST},
l AS ({_unpivot_sql("big", list(R.SCORE_METRICS), keys=("db",))}),
r AS (
  SELECT metric AS category, row_number() OVER (
           PARTITION BY metric ORDER BY CASE WHEN {_LOWER} THEN value ELSE -value END, db) AS place, db, value
  FROM l WHERE value IS NOT NULL)
SELECT * FROM r WHERE place <= 2""")
def leaderboard(spark, sf_dir):
    """Winner and runner-up per category."""
    return R.leaderboard(runs(spark, sf_dir))


@register("scaling_ratio", f"""WITH {RUNS_CTE},
l AS ({_unpivot_sql("runs", ["p50_ms", "qps"])})
SELECT db, metric, n_dataset, value, prev_value, CASE WHEN prev_value = 0 THEN NULL ELSE value / prev_value END AS ratio
FROM (SELECT *, lag(value) OVER (PARTITION BY db, metric ORDER BY n_dataset) AS prev_value FROM l)""")
def scaling_ratio(spark, sf_dir):
    """Each metric relative to the previous size of the same store."""
    return R.scaling_ratio(runs(spark, sf_dir))


@register("pareto_front", f"""WITH {RUNS_CTE}
SELECT a.n_dataset, a.db, a.recall_at_k, a.qps FROM runs a
WHERE NOT EXISTS (
  SELECT 1 FROM runs b WHERE b.n_dataset = a.n_dataset AND b.recall_at_k >= a.recall_at_k AND b.qps >= a.qps
    AND (b.recall_at_k > a.recall_at_k OR b.qps > a.qps))""")
def pareto_front(spark, sf_dir):
    """Runs not dominated on (recall, qps) within their size."""
    return R.pareto_front(runs(spark, sf_dir))


@register("scaling_slope", f"""WITH {RUNS_CTE},
l AS ({_unpivot_sql("runs", ["p50_ms", "p95_ms", "qps"])}),
p AS (SELECT db, metric, ln(value) AS y, ln(CAST(n_dataset AS DOUBLE)) AS x FROM l WHERE value > 0 AND n_dataset > 0),
m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY db, metric)),
s AS (SELECT db, metric, count(*) AS points, sum((x - mx) * (x - mx)) AS sxx, sum((y - my) * (y - my)) AS syy,
             sum((x - mx) * (y - my)) AS sxy, any_value(mx) AS mx, any_value(my) AS my FROM m GROUP BY db, metric)
SELECT db, metric, points, CASE WHEN sxx > 0 THEN sxy / sxx END AS slope, CASE WHEN sxx > 0 THEN my - sxy / sxx * mx END AS intercept,
       CASE WHEN sxx > 0 AND points > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (points - 2) / sxx) END AS slope_error,
       CASE WHEN sxx > 0 AND syy > 0 THEN 1 - greatest(syy - sxy * sxy / sxx, 0) / syy END AS r2
FROM s""")
def scaling_slope(spark, sf_dir):
    """Exponent of each store's latency and throughput in the size, with its error."""
    return R.scaling_slope(runs(spark, sf_dir))


@register("skyline_runs", f"""WITH {RUNS_CTE},
r AS (SELECT * FROM runs WHERE recall_at_k IS NOT NULL AND qps IS NOT NULL AND memory_mb IS NOT NULL AND p95_ms IS NOT NULL)
SELECT a.n_dataset, a.db, a.recall_at_k, a.qps, a.memory_mb, a.p95_ms FROM r a
WHERE NOT EXISTS (
  SELECT 1 FROM r b WHERE b.n_dataset = a.n_dataset AND b.recall_at_k >= a.recall_at_k AND b.qps >= a.qps
    AND b.memory_mb <= a.memory_mb AND b.p95_ms <= a.p95_ms
    AND (b.recall_at_k > a.recall_at_k OR b.qps > a.qps OR b.memory_mb < a.memory_mb OR b.p95_ms < a.p95_ms))""")
def skyline_runs(spark, sf_dir):
    """R16 in four measures: runs of each size that no other beats in recall, throughput, memory
    and p95 together."""
    from vecframe.operators.skyline import skyline

    measures = {"recall_at_k": False, "qps": False, "memory_mb": True, "p95_ms": True}
    return skyline(runs(spark, sf_dir), measures, ["n_dataset"]).select("n_dataset", "db", *measures)


@register("report_json", f"WITH {RUNS_CTE} SELECT * FROM runs")
def report_json(spark, sf_dir):
    """K1: one JSON object per run record, read back from the JSON by its schema: the report
    holds every value of the record."""
    record = runs(spark, sf_dir)
    return report_rows(record).select(F.from_json("json", record.schema).alias("r")).select("r.*")
