import math

import pytest
from pyspark.sql import functions as F

from vecframe.operators import ingest as I
from vecframe.operators import metrics as M

HITS = "query_id long, rank int, id long"


def test_recall_edge_cases(spark):
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 3), (2, 1, 9)], HITS)
    pred = spark.createDataFrame([(0, 1, 2), (0, 2, 2), (0, 3, 7), (1, 1, 4), (3, 1, 1)], HITS)
    got = {r.query_id: r.recall for r in M.recall_per_query(pred, truth, 5).collect()}
    # duplicates collapse; no prediction -> 0; no truth -> 0
    assert got == {0: 0.5, 1: 0.0, 2: 0.0, 3: 0.0}
    s = M.recall_summary(M.recall_per_query(pred, truth, 5)).first()
    vals = [0.5, 0.0, 0.0, 0.0]
    mean = sum(vals) / 4
    assert s.recall_at_k == pytest.approx(mean)
    assert s.recall_std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vals) / 4))
    one = M.recall_summary(M.recall_per_query(pred.filter("query_id = 0"), truth.filter("query_id = 0"), 5)).first()
    assert one.recall_std == 0.0 and one.n_queries == 1
    al = M.recall_alignment(pred, truth).first()
    assert (al.only_pred, al.only_truth, al.aligned) == (1, 1, False)
    with pytest.raises(ValueError):
        M.assert_aligned(pred, truth)


def test_latency_summaries_small_lists(spark):
    rows = [("a", 1, 5.0), ("b", 2, 1.0), ("b", 3, 3.0), ("c", 4, 4.0), ("c", 5, 1.0), ("c", 6, 3.0), ("c", 7, 2.0)]
    log = spark.createDataFrame(rows, "db string, uid long, ms double")
    got = {r.db: r for r in M.latency_summary(log, ["db"], "ms", ["uid"]).collect()}
    assert got["a"].p99_ms == 5.0 and got["a"].n == 1
    assert got["b"].p50_ms == 2.0
    assert got["c"].p95_ms == pytest.approx(3.85)
    low = {r.db: r for r in M.latency_lower_rank(log, ["db"], "ms", ["uid"]).collect()}
    assert low["c"].p50_ms == 2.0 and low["c"].p95_ms == 3.0 and low["c"].repeats == 4
    approx = {r.db: r for r in M.latency_summary_approx(log, ["db"], "ms").collect()}
    assert approx["c"].n == 4


def test_throughput(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(seconds=2)), ("b", t0)]
    log = spark.createDataFrame(rows, "db string, ts timestamp")
    got = {r.db: r for r in M.throughput_summary(log, ["db"], "ts").collect()}
    assert got["a"].qps == 1.0 and got["a"].duration_s == 2.0
    assert got["b"].qps == 0.0 and got["b"].total_queries == 1
    win = M.throughput_windows(log, ["db"], "ts", "1 second").collect()
    assert sum(r.requests for r in win) == 3


def test_round_robin(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, "a", t0 + dt.timedelta(seconds=i)) for i in range(5)], "eid long, db string, ts timestamp")
    qs = spark.createDataFrame([(10,), (20,)], "query_id long")
    got = sorted((r.seq, r.query_id) for r in M.round_robin_assign(log, ["db"], "ts", ["eid"], qs).collect())
    assert got == [(0, 10), (1, 20), (2, 10), (3, 20), (4, 10)]


BASE = "id long, text string"
BATCH = "id long, seq long, text string"


def test_upsert_and_inserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], BASE)
    batch = spark.createDataFrame([(2, 1, "b1"), (2, 5, "b5"), (3, 2, "c2"), (3, 1, "c1")], BATCH)
    up = dict(I.upsert_last_wins(base, batch, "id", "seq").collect())
    assert up == {1: "a", 2: "b5", 3: "c2"}
    ign = sorted(I.insert_ignore(base, batch, "id", "seq").collect())
    assert [tuple(r) for r in ign] == [(1, "a"), (2, "b"), (3, "c1")]
    assert I.insert_conflicts(base, batch, "id").count() == 2
    assert I.append_insert(base, batch.drop("seq")).count() == 6
    empty = I.truncate_keep_schema(spark, base)
    assert empty.count() == 0 and empty.schema == base.schema


def test_batch_plan(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = sorted(tuple(r) for r in I.batch_plan(df, "k", 256).collect())
    assert got == [(0, 256, 0, 255), (1, 256, 256, 511), (2, 256, 512, 767), (3, 232, 768, 999)]


def test_validate_vectors(spark):
    rows = [(1, "t", [1.0, 2.0]), (2, None, [1.0, 2.0]), (3, "t", None), (4, "t", [1.0]),
            (5, "t", [1.0, float("nan")]), (5, "t", [1.0, 2.0]), (None, "t", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    got = sorted((r.id if r.id is not None else -1, r.reason) for r in I.validate_vectors(df, "id", "embedding", 2, "text").collect())
    assert got == [(-1, "null_id"), (2, "null_text"), (3, "null_embedding"), (4, "wrong_dim"),
                   (5, "bad_element"), (5, "duplicate_key"), (5, "duplicate_key")]


def test_validation_of_a_hot_key(spark):
    hot = spark.range(25_003).select(F.lit(7).cast("long").alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    nulls = spark.range(50).select(F.lit(None).cast("long").alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    bad = I.validate_vectors(hot.unionByName(nulls), "id", "embedding", 1)
    assert {(r.id, r.reason): r["count"] for r in bad.groupBy("id", "reason").count().collect()} == {(7, "duplicate_key"): 25_003, (None, "null_id"): 50}
    assert "Join" not in bad._jdf.queryExecution().executedPlan().toString()


def test_payload_bounds_and_optional(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x" * 2000, "t" * 100)], "id long, text string, topic string")
    got = {r.id: (r.text, r.topic) for r in I.bound_payload(df).collect()}
    assert got[1] == ("", "") and len(got[2][0]) == 1024 and len(got[2][1]) == 64
    st = I.stack_optional([df, spark.createDataFrame([(3, "z")], "id long, text string")])
    assert st.filter("id = 3").first().topic is None


def test_null_groups_are_groups(spark):
    """A NULL store keeps its rows in percentiles, summaries and merged records."""
    rows = [(i, None if i % 4 == 0 else "a", float(i)) for i in range(20)]
    log = spark.createDataFrame(rows, "event_id long, db string, ms double")
    got = {r.db: r for r in M.latency_summary(log, ["db"], "ms", ["event_id"]).collect()}
    import numpy as np

    for db in (None, "a"):
        values = [v for _, d, v in rows if d == db]
        assert got[db].n == len(values) and abs(got[db].p95_ms - np.percentile(values, 95)) < 1e-9
    low = {r.db: r.p50_ms for r in M.latency_lower_rank(log, ["db"], "ms", ["event_id"]).collect()}
    assert low == {None: 8.0, "a": 10.0}
    parts = [log.groupBy("db").count().withColumnRenamed("count", "n"), log.groupBy("db").agg(F.max("ms").alias("top"))]
    merged = {r.db: (r.n, r.top) for r in M.metric_record(parts, ["db"]).collect()}
    assert merged == {None: (5, 16.0), "a": (15, 19.0)}


def test_equal_sequence_numbers_have_one_winner(spark):
    base = spark.createDataFrame([(9, "old")], "id long, text string")
    rows = [(1, 5, t) for t in ("a", "b", "c", "d")] + [(1, 4, "z"), (2, 1, "x")]
    got = set()
    for parts in (1, 3, 7):
        batch = spark.createDataFrame(rows, "id long, seq long, text string").repartition(parts)
        got.add(tuple(sorted(map(tuple, I.upsert_last_wins(base, batch, "id", "seq").collect()))))
    assert len(got) == 1 and (1, "z") not in got.pop()
