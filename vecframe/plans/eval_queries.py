"""Registered evaluation queries.

The latency log is the ``events`` table: ``event_type`` plays the store (``db``),
``value`` the request time in ms, ``ts`` the completion time and ``event_id`` the unique
tie-break. A run is one (db, week) slice; ``n_dataset`` is the week number since the
epoch, the axis along which the suite reports scale.

Recall compares two real searches over the ``embeddings`` table scaled by ``1 + label``:
L2 on the raw vectors (the prediction, like the SQL store that ranks raw vectors by
``<->``) against cosine (the ground truth, like the exact normalised index).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecframe.functions.temporal import epoch_seconds
from vecframe.operators import metrics as M
from vecframe.operators import search as S
from vecframe.operators import sketches as Q
from vecframe.operators.ranking import join_null_safe
from vecframe.plans.registry import register
from vecframe.plans.search_queries import scaled_vectors
from vecframe.plans.tables import table
from vecframe.session import cut_lineage, ensure_checkpoint_dir

K = 5


def latency_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("db"),
        F.floor(epoch_seconds("ts") / 604800).cast("long").alias("n_dataset"),
        F.col("value").alias("ms"),
        "ts",
        "props",
    )


_EV = """ev AS (
  SELECT event_id, event_type AS db, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS n_dataset,
         value AS ms, ts, props
  FROM events)"""


@register("percentile_linear", f"""
WITH {_EV}
SELECT db, unnest([0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS p, unnest(qs) AS value
FROM (SELECT db, quantile_cont(ms, [0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]) AS qs FROM ev GROUP BY db)
""")
def percentile_linear(spark, sf_dir):
    """A1: exact percentiles with linear interpolation at ``p*(n-1)``."""
    return M.percentiles(latency_log(spark, sf_dir), ["db"], "ms", ["event_id"],
                         [0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0], groups_bounded=True)


@register("latency_summary", f"""
WITH {_EV}
SELECT db, avg(ms) AS avg_ms, quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.95) AS p95_ms,
       quantile_cont(ms, 0.99) AS p99_ms, count(ms) AS n
FROM ev GROUP BY db
""")
def latency_summary(spark, sf_dir):
    """A2: avg/p50/p95/p99/n per store."""
    return M.latency_summary(latency_log(spark, sf_dir), ["db"], "ms", ["event_id"], groups_bounded=True)


@register("latency_summary_approx", f"""
WITH {_EV}
SELECT db, avg(ms) AS avg_ms, count(ms) AS n, true AS p50_within, true AS p95_within, true AS p99_within
FROM ev GROUP BY db
""")
def latency_summary_approx(spark, sf_dir):
    """A2 with the bounded-memory sketch: avg and n, and for each percentile whether its
    rank in the log is within the sketch's error of ``n / accuracy`` (and one row)."""
    log = latency_log(spark, sf_dir).select("db", "ms")
    sketch = M.latency_summary_approx(log, ["db"], "ms", accuracy=10_000)
    j = join_null_safe(log, F.broadcast(sketch), ["db"])  # one row per store
    checks = []
    for p, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        slack = F.first("n") / 10_000 + 1
        below, upto = F.count_if(F.col("ms") < F.col(f"{c}_ms")), F.count_if(F.col("ms") <= F.col(f"{c}_ms"))
        checks.append(((below - slack <= p * F.first("n")) & (p * F.first("n") <= upto + slack)).alias(f"{c}_within"))
    return j.groupBy("db").agg(F.first("avg_ms").alias("avg_ms"), F.first("n").alias("n"), *checks)


_LEVEL = """SELECT '{0}' AS level, {1} AS db, {2} AS n_dataset, count(ms) AS n, avg(ms) AS avg_ms, min(ms) AS min_ms,
       max(ms) AS max_ms, true AS p50_within, true AS p95_within, true AS p99_within FROM ev {3}"""


@register("latency_sketch_rollup", f"""
WITH {_EV}
{_LEVEL.format("store", "db", "NULL::VARCHAR", "GROUP BY db")}
UNION ALL {_LEVEL.format("week", "NULL::VARCHAR", "n_dataset::VARCHAR", "GROUP BY n_dataset")}
UNION ALL {_LEVEL.format("all", "NULL::VARCHAR", "NULL::VARCHAR", "")}
""")
def latency_sketch_rollup(spark, sf_dir):
    """A2 from one stored sketch per run, merged over weeks, over stores and over all: count,
    mean and range, and for each percentile whether its rank error, measured on the log, is
    within the bound of the sketch."""
    log = latency_log(spark, sf_dir).select("db", "n_dataset", "ms")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    Q.save_sketches(Q.run_sketches(log, ["db", "n_dataset"], "ms"), path, "n_dataset")
    runs = spark.read.parquet(path)
    levels = {"store": ["db"], "week": ["n_dataset"], "all": []}
    return Q.sketch_rollup(log, runs, levels, {"db": "string", "n_dataset": "string"}, "ms")


@register("latency_lower_rank", f"""
WITH {_EV},
r AS (SELECT db, ms, row_number() OVER (PARTITION BY db ORDER BY ms, event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY db) AS n FROM ev)
SELECT db, avg(ms) AS avg_ms,
       max(CASE WHEN pos = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN ms END) AS p50_ms,
       max(CASE WHEN pos = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN ms END) AS p95_ms,
       count(*) AS repeats
FROM r GROUP BY db
""")
def latency_lower_rank(spark, sf_dir):
    """A3: repeat-search summary with lower nearest-rank percentiles."""
    return M.latency_lower_rank(latency_log(spark, sf_dir), ["db"], "ms", ["event_id"], groups_bounded=True)


# ------------------------------------------------------------------ recall

def _pred_truth(spark, sf_dir):
    v = scaled_vectors(spark, sf_dir)
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pred = S.exact_topk(v, q, K, "l2")
    truth = S.exact_topk(v, q, K, "cosine")
    return pred, truth


_PT = """e AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x * (label + 1) AS FLOAT) AS DOUBLE)) AS v
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, list_distance(q.v, c.v) AS dist,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS cos
  FROM e AS q CROSS JOIN e AS c),
pred AS (SELECT query_id, id FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= 5),
truth AS (SELECT query_id, id FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) <= 5),
per AS (
  SELECT t.query_id, count(*) AS truth_n, count(p.id) AS found
  FROM truth t LEFT JOIN pred p ON t.query_id = p.query_id AND t.id = p.id GROUP BY t.query_id),
rq AS (SELECT query_id, CASE WHEN truth_n = 0 THEN 0.0 ELSE found / truth_n END AS recall FROM per)"""


@register("recall_per_query", f"WITH {_PT} SELECT query_id, recall FROM rq")
def recall_per_query(spark, sf_dir):
    """A4: Recall@5 of raw-L2 search against cosine ground truth, per query."""
    pred, truth = _pred_truth(spark, sf_dir)
    return M.recall_per_query(pred, truth, K)


@register("recall_summary", f"""WITH {_PT}
SELECT avg(recall) AS recall_at_k, CASE WHEN count(*) > 1 THEN stddev_pop(recall) ELSE 0.0 END AS recall_std,
       count(*) AS n_queries FROM rq""")
def recall_summary(spark, sf_dir):
    """A5: mean Recall@5, population std and query count."""
    pred, truth = _pred_truth(spark, sf_dir)
    return M.recall_summary(M.recall_per_query(pred, truth, K))


@register("recall_alignment", f"""WITH {_PT},
al AS (SELECT (SELECT count(DISTINCT query_id) FROM pred) AS pred_queries,
       (SELECT count(DISTINCT query_id) FROM truth) AS truth_queries,
       (SELECT count(*) FROM (SELECT DISTINCT query_id FROM pred) a
         WHERE query_id NOT IN (SELECT query_id FROM truth)) AS only_pred,
       (SELECT count(*) FROM (SELECT DISTINCT query_id FROM truth) a
         WHERE query_id NOT IN (SELECT query_id FROM pred)) AS only_truth)
SELECT *, (only_pred = 0 AND only_truth = 0) AS aligned FROM al""")
def recall_alignment(spark, sf_dir):
    """Predictions and ground truth cover the same queries."""
    pred, truth = _pred_truth(spark, sf_dir)
    return M.recall_alignment(pred, truth)


# ------------------------------------------------------------------ throughput

@register("throughput_summary", f"""
WITH {_EV}
SELECT db,
       CASE WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 0
            THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) ELSE 0.0 END AS qps,
       count(*) AS total_queries,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s
FROM ev GROUP BY db
""")
def throughput_summary(spark, sf_dir):
    """Queries per second over the log of each store."""
    return M.throughput_summary(latency_log(spark, sf_dir), ["db"], "ts")


@register("throughput_windows", f"""
WITH {_EV}
SELECT db, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS window_start_s, count(*) AS requests
FROM ev GROUP BY ALL
""")
def throughput_windows(spark, sf_dir):
    """Requests per store per one-hour tumbling window."""
    return M.throughput_windows(latency_log(spark, sf_dir), ["db"], "ts", "1 hour")


@register("round_robin_queries", f"""
WITH {_EV},
q AS (SELECT vec_id AS query_id, row_number() OVER (ORDER BY vec_id) - 1 AS qpos, count(*) OVER () AS nq FROM embeddings),
s AS (SELECT event_id, db, ts, row_number() OVER (PARTITION BY db ORDER BY ts, event_id) - 1 AS seq FROM ev)
SELECT s.event_id, s.db, s.seq, q.query_id FROM s JOIN q ON q.qpos = s.seq % q.nq
""")
def round_robin_queries(spark, sf_dir):
    """Every request of a store cycles through the query table in order."""
    log = latency_log(spark, sf_dir).select("event_id", "db", "ts")
    qs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    out = M.round_robin_assign(log, ["db"], "ts", ["event_id"], qs)
    return out.select("event_id", "db", "seq", "query_id")


# ------------------------------------------------------------------ run records

def runs(spark, sf_dir):
    """The metric record of every (db, week) run, in 16 columns. A request searches with the
    vector numbered ``event_id`` modulo the table's rows; the run's recall is that of its
    requests' searches (raw L2 against cosine ground truth)."""
    ev = latency_log(spark, sf_dir)
    keys = ["db", "n_dataset"]
    vectors = table(spark, sf_dir, "embeddings").count()
    found = M.recall_per_query(*_pred_truth(spark, sf_dir), K)
    asked = ev.withColumn("query_id", F.pmod("event_id", F.lit(max(vectors, 1)))).join(found, "query_id", "left")
    extra = asked.groupBy(*keys).agg(
        F.sum("ms").alias("insert_ms"),
        F.count(F.lit(1)).alias("insert_count"),
        F.avg(F.get_json_object("props", "$.k").cast("double")).alias("memory_mb"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_k"),
        F.when(F.count("recall") > 1, F.stddev_pop("recall")).otherwise(F.lit(0.0)).alias("recall_std"),
        F.count("recall").alias("n_queries"),
    )
    lat = M.latency_summary(ev, keys, "ms", ["event_id"], groups_bounded=True)  # stores x weeks
    thr = M.throughput_summary(ev, keys, "ts")
    rec = M.metric_record([extra, lat, thr], keys)
    # one row per store and size, read several times by every report: written once
    return cut_lineage(rec.select(
        "db", "insert_ms", "insert_count", "memory_mb", "avg_ms", "p50_ms", "p95_ms", "p99_ms", "n",
        "recall_at_k", "recall_std", "n_queries", "qps", "total_queries", "duration_s", "n_dataset",
    ))


RUNS_CTE = f"""{_EV},
{_PT},
asked AS (SELECT ev.*, rq.recall FROM ev LEFT JOIN rq ON rq.query_id = ev.event_id % (SELECT greatest(count(*), 1) FROM embeddings)),
runs AS (
  SELECT db, sum(ms) AS insert_ms, count(*) AS insert_count,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS memory_mb,
         avg(ms) AS avg_ms, quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.95) AS p95_ms,
         quantile_cont(ms, 0.99) AS p99_ms, count(ms) AS n,
         coalesce(avg(recall), 0.0) AS recall_at_k,
         CASE WHEN count(recall) > 1 THEN stddev_pop(recall) ELSE 0.0 END AS recall_std,
         count(recall) AS n_queries,
         CASE WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 0
              THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) ELSE 0.0 END AS qps,
         count(*) AS total_queries,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s,
         n_dataset
  FROM asked GROUP BY db, n_dataset)"""


@register("metric_record", f"WITH {RUNS_CTE} SELECT * FROM runs")
def metric_record(spark, sf_dir):
    """One 16-column record per run (latency + recall + throughput + insert + memory)."""
    return runs(spark, sf_dir)


@register("insert_speed", f"""WITH {RUNS_CTE}
SELECT db, n_dataset, insert_ms / 1000.0 AS insert_s,
       CASE WHEN insert_ms = 0 THEN NULL ELSE insert_count / (insert_ms / 1000.0) END AS vectors_per_s FROM runs""")
def insert_speed(spark, sf_dir):
    """Insert seconds and vectors per second."""
    return M.insert_speed(runs(spark, sf_dir))


@register("total_time", f"""WITH {RUNS_CTE}
SELECT db, n_dataset, insert_ms / 1000.0 + avg_ms * n / 1000.0 + duration_s AS approx_total_s FROM runs""")
def total_time(spark, sf_dir):
    """Approximate total time of a run."""
    return M.total_time(runs(spark, sf_dir))


@register("metric_checks", f"""WITH {RUNS_CTE},
c AS (
  SELECT db, n_dataset, 'p50_le_p95' AS "check", p50_ms <= p95_ms AS ok FROM runs
  UNION ALL SELECT db, n_dataset, 'p95_le_p99', p95_ms <= p99_ms FROM runs
  UNION ALL SELECT db, n_dataset, 'insert_count_eq_n', insert_count = n FROM runs
  UNION ALL SELECT db, n_dataset, 'qps_near_inverse_latency',
         abs(qps - 1000.0 / avg_ms) <= 0.5 * (1000.0 / avg_ms) FROM runs)
SELECT * FROM c""")
def metric_checks(spark, sf_dir):
    """Documented consistency rules per run."""
    return M.metric_checks(runs(spark, sf_dir))
