import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.operators import sketches as K

LOG = "db string, week long, ms double"


def wide_log(spark):
    """A hot run, heavy ties, a long tail, a run of one value and a null key."""
    rng = np.random.default_rng(3)
    rows = [("hot", 1, float(x)) for x in rng.lognormal(3, 2, 40_000)]
    rows += [("ties", 1 + i % 3, float(i % 7)) for i in range(9_000)]
    rows += [("hot", 2, float(x)) for x in rng.normal(1e6, 1, 5_000)]
    rows += [("one", 3, 5.0), (None, 2, 1.0), (None, 2, 3.0), ("void", 3, None), ("void", 3, float("nan"))]
    return spark.createDataFrame(rows, LOG).repartition(11)


def test_merged_sketches_keep_the_bound(spark):
    log = wide_log(spark)
    runs = K.run_sketches(log, ["db", "week"], "ms")
    for cols in (["db"], ["week"], []):
        summary = K.sketch_summary(K.merge_sketches(runs, cols), cols)
        errors = K.rank_errors(log, summary, cols, "ms").collect()
        assert errors and all(e[c] <= K.rank_bound() for e in errors for c in ("err_p50", "err_p95", "err_p99"))
    exact = {r.db: r for r in log.where("ms is not null and not isnan(ms)").groupBy("db").agg(
        F.count("ms").alias("n"), F.avg("ms").alias("a"), F.min("ms").alias("lo"), F.max("ms").alias("hi")).collect()}
    got = {r.db: r for r in K.sketch_summary(K.merge_sketches(runs, ["db"]), ["db"]).collect()}
    assert set(got) == set(exact) == {"hot", "ties", "one", None}
    for db, e in exact.items():
        assert (got[db].n, got[db].min_ms, got[db].max_ms) == (e.n, e.lo, e.hi) and got[db].avg_ms == pytest.approx(e.a)
    assert got["one"].p50_ms == got["one"].p99_ms == 5.0


def test_a_small_sketch_has_a_larger_error(spark):
    """The measured error is real: it moves with the sketch's size and with wrong answers."""
    log = spark.range(200_000).select(F.lit("a").alias("db"), F.lit(1).alias("week"), F.xxhash64("id").cast("double").alias("ms"))
    worst = {}
    for k in (8, 2048):
        summary = K.sketch_summary(K.run_sketches(log, ["db"], "ms", k), ["db"])
        [e] = K.rank_errors(log, summary, ["db"], "ms").collect()
        worst[k] = max(e.err_p50, e.err_p95, e.err_p99)
    assert worst[2048] < K.rank_bound(2048) < 0.005 and worst[8] > worst[2048]
    wrong = summary.withColumn("p95_ms", F.col("p50_ms"))
    assert K.rank_errors(log, wrong, ["db"], "ms").first().err_p95 > 0.4


def test_stored_weeks_are_added_and_replaced(spark, tmpdir_path):
    log, path = wide_log(spark), f"{tmpdir_path}/sketches"
    for week in (1, 2, 3, 2):  # week 2 is written again
        K.save_sketches(K.run_sketches(log.where(F.col("week") == week), ["db", "week"], "ms"), path, "week")
    stored = spark.read.parquet(path)
    assert stored.count() == log.select("db", "week").distinct().count()
    [total] = K.sketch_summary(K.merge_sketches(stored, []), []).collect()
    assert total.n == log.where("ms is not null and not isnan(ms)").count()


def test_sketch_edges(spark):
    log = wide_log(spark)
    void = K.sketch_summary(K.run_sketches(log.where("db = 'void'"), ["db"], "ms"), ["db"]).first()
    assert void.n == 0 and void.p50_ms is None and void.avg_ms is None
    none = K.run_sketches(log.limit(0), ["db", "week"], "ms")
    assert none.count() == 0 and K.merge_sketches(none, ["db"]).count() == 0 == K.merge_sketches(none, []).count()
    plan = K.merge_sketches(K.run_sketches(log, ["db", "week"], "ms"), ["db"])
    assert plan.columns == ["db", "sketch", "n", "total", "least", "most"]
