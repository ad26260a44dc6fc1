"""What a search task holds at once: bounded by block sizes, not by the rows or pairs it meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ann_index import by_query, clustered, frames, plain

from vecframe.operators import ann as A
from vecframe.operators import pivots as P
from vecframe.operators import search as S
from vecframe.plans import rag_queries, report_queries
from vecframe.session import BROADCAST_BYTES_KEY


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_a_task_holds_k_rows_a_query(metric, monkeypatch):
    """However many batches come, rows in rising order of nearness among them."""
    monkeypatch.setattr(S, "EXACT_PAIRS", 64)
    rng = np.random.default_rng(2)
    X, Q = rng.normal(size=(3000, 8)), rng.normal(size=(40, 8))
    X[50:90] = X[7]
    X[100] = Q[3] = 0.0
    X = X[np.argsort(X @ Q[0])]
    found = S.AllPairs(Q, np.arange(40), 6, metric)
    for at in range(0, 3000, 700):
        found.scan(X[at:at + 700], np.arange(at, min(3000, at + 700)))
        assert len(found.frame()) <= 240
    got = found.frame()
    for q in range(40):
        scores = S.exact_pair_scores(X, np.broadcast_to(Q[q], X.shape), metric) * (1 if metric == "l2" else -1)
        assert got[got.query_id == q]["id"].tolist() == np.lexsort((np.arange(3000), scores))[:6].tolist()


def test_keyed_rows_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(A, "MAX_PAIRS", 500)
    X = clustered(400, clusters=2)
    for share in (0.0, 2.0):  # by a matrix product, by listed pairs
        monkeypatch.setattr(A, "DENSE_SHARE", share)
        keys = lambda rows: (rows[:, :2] > 0).astype(np.int64) + [0, 2]
        found = A.KeyedScorer(keys, keys(X[:60]), 5, "l2")(X, np.arange(400), X[:60], np.arange(60))
        assert len(found) <= 5 * 60
        meets = (keys(X)[None, :, :] == keys(X[:60])[:, None, :]).any(axis=2)
        for q in range(60):
            d = np.where(meets[q], np.linalg.norm(X - X[q], axis=1), np.inf)
            assert found[found.query_id == q]["id"].tolist() == np.lexsort((np.arange(400), d))[:5].tolist()


def test_many_answers_leave_a_task_once_a_corpus_block(spark, monkeypatch):
    X = clustered(150)
    c, q = frames(spark, X)
    more = c.unionByName(spark.createDataFrame([(900, [float("nan")] * X.shape[1])], c.schema))
    wanted = plain(X, range(150), 40, "cosine")
    monkeypatch.setattr(S, "MAX_MOVED", 100)
    seen = []
    monkeypatch.setattr(S, "rank_candidates", lambda cands, *a, f=S.rank_candidates, **b: seen.append(cands.count()) or f(cands, *a, **b))
    assert by_query(S.exact_topk(more.repartition(6), q, 40, "cosine")) == wanted
    assert seen == [150 * 40]
    spark.conf.set(BROADCAST_BYTES_KEY, str(40 * 8 * X.shape[1]))  # four blocks
    try:
        assert by_query(S.exact_topk(more, q, 40, "cosine")) == wanted
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    with pytest.raises(ValueError):
        S.exact_topk(c.unionByName(spark.createDataFrame([(901, [1.0])], c.schema)), q, 40, "cosine")


def test_blocks_are_collected_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL_QUERIES", 10)
    X = clustered(60)
    _, q = frames(spark, X)
    blocks, n, dim = S.query_blocks(q, 20 * 8 * X.shape[1])
    assert isinstance(blocks, S.Blocks) and (len(blocks), n, dim) == (3, 60, X.shape[1])
    assert sorted(i for ids, _ in blocks for i in ids) == list(range(60))
    assert len(S.query_blocks(q, 20 * 8 * X.shape[1], k=X.shape[1])[0]) == 6  # room for the answers


def test_pivot_bounds_are_found_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 16)
    X = clustered(300)
    c, _ = frames(spark, X)
    cells, sizes = P.fit_cells(c, 4, "l2"), []
    monkeypatch.setattr(P, "reach", lambda cells, Q, k, f=P.reach: sizes.append(len(Q)) or f(cells, Q, k))
    found = P.PivotScorer(cells, X[:70], np.arange(70), 4)
    for at in (0, 150):
        found.scan(X[at:at + 150], np.arange(at, at + 150))
    assert sizes and max(sizes) <= 16
    got = found.frame()
    assert {i: got[got.query_id == i]["id"].tolist() for i in range(70)} == plain(X, range(70), 4, "l2")


def test_binary_codes_make_no_pairs_in_the_plan(spark):
    X = clustered(120)
    c, q = frames(spark, X)
    plan = A.binary_topk(c, q, 4, num_candidates=15)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    radii = A.Radii(A.matrix_codes(X), 64, 15)
    for at in range(0, 120, 50):
        radii.scan(A.matrix_codes(X[at:at + 50]))
    d = ((X >= 0)[:, None, :] != (X >= 0)[None, :, :]).sum(axis=2)
    assert radii.radius.tolist() == np.sort(d, axis=1)[:, 14].tolist()
    assert radii.count.sum(axis=1).tolist() == (d <= radii.radius[:, None]).sum(axis=1).tolist()


def test_chunk_vectors_are_written_once(spark, tmp_path):
    docs = [(i, f"word{i} of the text number {i}", "en") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "word3 text"), (1, 1, "assistant", "no"), (2, 0, "user", "number 5")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = rag_queries.contexts(spark, str(tmp_path)).drop("text")
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 * 5


def test_records_without_a_store_are_stacked(spark, monkeypatch):
    runs = spark.createDataFrame([("view", 3, 1.0), (None, 3, 2.0), ("click", 2, None)], "db string, n_dataset long, memory_mb double")
    monkeypatch.setattr(report_queries, "runs", lambda spark, sf_dir: runs)
    assert sorted(map(str, report_queries.stacked(spark, "").collect())) == sorted(map(str, runs.collect()))
    bars = {(r.db, r.metric): r.value for r in report_queries.R.bar_values(report_queries.stacked(spark, ""), ["memory_mb"]).collect()}
    assert bars == {("view", "memory_mb"): 1.0, (None, "memory_mb"): 2.0}
