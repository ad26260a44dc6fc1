import pytest
from pyspark.sql import functions as F

from vecframe.operators import rag as G
from vecframe.operators import reports as R

RUNS = ("db string, n_dataset long, p50_ms double, p95_ms double, p99_ms double, avg_ms double, insert_ms double, "
        "qps double, memory_mb double, recall_at_k double, recall_std double, n_queries long")


def runs(spark):
    rows = [
        ("x", 1, 1.0, 2.0, 3.0, 1.5, 10.0, 100.0, None, 0.9, 0.1, 5),
        ("y", 1, 2.0, 4.0, 5.0, 2.5, 20.0, 50.0, None, 0.9, 0.0, 5),
        ("x", 2, 1.5, 2.5, 3.5, 2.0, 30.0, 80.0, None, 0.8, 0.1, 5),
        ("y", 2, 3.0, 6.0, 7.0, 4.0, 30.0, 90.0, None, 0.95, 0.05, 5),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_normalised_scores(spark):
    s = {(r.db, r.metric): r.score for r in R.normalized_scores(runs(spark)).collect()}
    assert s[("x", "p50_ms")] == 1.0 and s[("y", "p50_ms")] == 0.0      # lower is better
    assert s[("x", "insert_ms")] == 0.5                                   # constant column
    assert s[("x", "memory_mb")] == 0.5                                   # missing value
    assert s[("y", "recall_at_k")] == 1.0 and s[("x", "qps")] == 0.0
    hm = R.heatmap_matrix(runs(spark))
    metrics = {r.metric for r in hm.collect()}
    assert "memory_mb" not in metrics and hm.columns == ["metric", "x", "y"]


def test_leaderboard_series_pareto(spark):
    lb = {(r.category, r.place): r.db for r in R.leaderboard(runs(spark)).collect()}
    assert lb[("p50_ms", 1)] == "x" and lb[("qps", 1)] == "y" and lb[("insert_ms", 1)] == "x"
    ser = R.metric_series(runs(spark)).filter("db = 'x' AND metric = 'qps'").orderBy("point").collect()
    assert [r.value for r in ser] == [100.0, 80.0]
    ratio = R.scaling_ratio(runs(spark)).filter("db = 'y' AND metric = 'qps' AND n_dataset = 2").first()
    assert ratio.ratio == pytest.approx(1.8)
    front = {(r.n_dataset, r.db) for r in R.pareto_front(runs(spark)).collect()}
    assert front == {(1, "x"), (2, "y")}
    assert R.largest_slice(runs(spark)).count() == 2
    t = {r.database: r for r in R.summary_throughput(runs(spark)).collect()}
    assert t["X"].memory_mb == "N/A" and t["Y"].throughput_qps == "90"


def test_question_intake_stops_at_exit(spark):
    rows = [(1, 0, "  first? "), (1, 1, "   "), (1, 2, "EXIT"), (1, 3, "after"), (2, 0, "quit"), (3, 0, "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = sorted((r.conv_id, r.turn, r.question) for r in G.question_intake(df, "conv_id", "turn", "text").collect())
    assert got == [(1, 0, "first?"), (3, 0, "only")]


def test_prompts_and_answers(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "qid long, question string")
    ctx = spark.createDataFrame([(1, 2, "b", "second"), (1, 1, "a", "first"), (2, 1, None, "solo")],
                                "qid long, rank int, topic string, text string")
    p = {r.qid: r.prompt for r in G.build_prompts(q, ctx, ["qid"]).collect()}
    assert "[Source 1 | topic=a] first\n\n[Source 2 | topic=b] second" in p[1]
    assert p[1].startswith(G.PROMPT_HEAD + "q1" + G.PROMPT_SOURCES)
    assert p[3].endswith(G.PROMPT_SOURCES + G.PROMPT_TAIL)
    a = {r.qid: r.answer for r in G.fallback_answers(q, ctx, ["qid"]).collect()}
    assert a[1] == (G.ANSWER_BEST % "first") + "\n" + (G.ANSWER_SECOND % "second")
    assert a[2] == G.ANSWER_BEST % "solo"
    assert a[3] == G.ANSWER_NONE


def test_corpus_query_texts(spark):
    docs = spark.createDataFrame([(i, "t" * 300) for i in range(3)], "doc_id long, text string")
    got = sorted((r.query_id, r.query_text) for r in G.corpus_query_texts(docs, "doc_id", "text").collect())
    assert len(got) == 4 and got[-1] == (3, "What is this document about?") and len(got[0][1]) == 200
