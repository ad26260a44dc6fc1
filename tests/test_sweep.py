"""Searches with many answers: the corpus is broadcast, answers are whole where they are found."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ann_index import by_query, clustered, frames, plain

from vecframe.functions import embed as E
from vecframe.operators import ann as A
from vecframe.operators import metrics as M
from vecframe.operators import pq as PQ
from vecframe.operators import search as S
from vecframe.session import BROADCAST_BYTES_KEY

SIZES = [50, 120, 200]


def many(monkeypatch):
    monkeypatch.setattr(S, "MAX_MOVED", 100)
    monkeypatch.setattr(S, "VISIT_ROWS", 37)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def answers(df) -> dict:
    return {(r["n"], r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("blocks", [1, 4])
def test_answers_leave_their_task_ranked(spark, monkeypatch, blocks):
    X = clustered(150)
    c, q = frames(spark, X)
    wanted = plain(X, range(150), 40, "cosine")
    many(monkeypatch)
    spark.conf.set(BROADCAST_BYTES_KEY, str(-(-150 // blocks) * 8 * X.shape[1]))
    try:
        hits = S.exact_topk(c.repartition(3), q, 40, "cosine")
        assert by_query(hits) == wanted
        assert not re.search("Window|Exchange hashpartitioning", plan_of(hits))
        assert {r["rank"] for r in hits.collect()} == set(range(1, 41))
        others = S.exact_topk(c, q, 39, "cosine", exclude_self=True)
        assert by_query(others) == {i: [x for x in plain(X, [i], 150, "cosine")[i] if x != i][:39] for i in range(150)}
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_repeated_ids_are_ranked_together(spark, monkeypatch):
    X = clustered(60)
    c, q = frames(spark, X)
    wanted = plain(X, range(60), 20, "cosine")
    many(monkeypatch)
    assert by_query(S.exact_topk(c.unionByName(c), q, 20, "cosine")) == wanted
    assert by_query(S.exact_topk(c, q.unionByName(q), 20, "cosine")) == wanted


@pytest.mark.parametrize("k", [3, 200])
def test_waiting_rows_are_sorted_in_at_once(monkeypatch, k):
    """Equal scores and repeated rows among them; a sort for as many rows as there are places."""
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 300, 3000).astype(float)
    ids = np.concatenate([np.arange(2000), rng.integers(0, 2000, 1000)])
    scores[2000:] = scores[ids[2000:]]
    best, sorts = S.Best(2, k, "ip"), []
    monkeypatch.setattr(best, "settle", lambda f=best.settle: sorts.append(best.held > 0) or f())
    for at in range(0, 3000, 10):
        best.add(np.zeros(10, np.int64), ids[at:at + 10], scores[at:at + 10])
    q, got, _ = best.rows()
    first = dict(zip(ids.tolist(), scores.tolist(), strict=True))
    assert got.tolist() == sorted(first, key=lambda i: (-first[i], i))[:k] and not q.any()
    assert sum(sorts) <= 4


@pytest.mark.parametrize("blocks", [1, 5])
def test_all_sizes_in_one_pass(spark, monkeypatch, blocks):
    X = clustered(200)
    X[180], X[77, 0] = X[3], np.nan
    c, q = frames(spark, X)
    q = q.where("query_id <> 77")
    cents = spark.createDataFrame([(i, X[i].tolist()) for i in range(0, 30, 6)], "cell int, centroid array<double>")
    searches = {
        "exact": lambda c, **b: S.exact_topk(c, q, 5, "cosine", **b),
        "lsh": lambda c, **b: A.lsh_topk(c, q, 5, "cosine", bands=4, bits=3, **b),
        "ivf": lambda c, **b: A.ivf_topk(c, q, cents, 5, "cosine", nprobe=2, **b),
        "two": lambda c, **b: A.twostage_topk(c, q, 5, "cosine", num_candidates=12, prefix_dims=4, dim=X.shape[1], **b),
    }
    wanted = {k: {n: by_query(f(c.where(F.col("id") < n))) for n in SIZES} for k, f in searches.items()}
    apart = answers(searches["two"](c, sizes=SIZES))
    many(monkeypatch)
    spark.conf.set(BROADCAST_BYTES_KEY, str(-(-200 // blocks) * 8 * X.shape[1]))
    try:
        sweep = S.sweep_of(c.select("id", F.col("embedding").alias("vec")), q, 199, 5, X.shape[1], SIZES)
        for name, f in searches.items():
            for sizes in (SIZES, sweep):
                hits = f(c, sizes=sizes)
                assert plan_of(hits).count("MapInArrow") == 1 and "Window" not in plan_of(hits)
                for n in SIZES:
                    assert by_query(hits.where(F.col("n") == n)) == wanted[name][n], (name, n)
        assert answers(searches["two"](c, sizes=sweep)) == apart
        assert answers(S.size_sweep_topk(c, q, sweep, 5)) == answers(searches["exact"](c, sizes=sweep))
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_coded_candidates_do_not_leave_their_task(spark, monkeypatch, tmp_path):
    X = clustered(400)
    c, q = frames(spark, X)
    index = PQ.build_pq(c, PQ.fit_pq(c, cells=6, subspaces=4), str(tmp_path))
    wanted = {n: by_query(PQ.pq_topk(index, q, 5, nprobe=n, rerank=30)) for n in (2, 6)}
    many(monkeypatch)
    for n in (2, 6):
        hits = PQ.pq_topk(index, q, 5, nprobe=n, rerank=30)
        assert not re.search("Window|Exchange hashpartitioning", plan_of(hits))
        got = by_query(hits)
        same = sum(len(set(got[i]) & set(wanted[n][i])) for i in wanted[n])
        assert set(got) == set(wanted[n]) and same >= 0.995 * sum(map(len, wanted[n].values()))  # 30th places may be equally far


def test_shared_keys_of_one_column():
    rng = np.random.default_rng(0)
    rows, queries = rng.integers(0, 9, (40, 1)), np.array([rng.permutation(9)[:4] for _ in range(20)])
    keys = A.SharedKeys(rows, queries)
    at, which = np.arange(5, 40), np.arange(3, 20)
    assert (keys.matrix(which, at) == (queries[which][:, None, :] == rows[at][None, :, :]).any(axis=2)).all()


def test_texts_are_counted_together(spark, monkeypatch):
    """Tokens are not exploded into rows; rows of one id are one text, and a NULL is a text without words."""
    monkeypatch.setattr(E, "TOKENS_AT_ONCE", 3)
    texts = [(1, "One two, TWO; three"), (1, "two"), (2, None), (3, ""), (4, "..."), (None, "ünï 7"), (None, "7"), (5, "a " * 9)]
    df = spark.createDataFrame(texts, "id long, text string")
    out = E.hash_embed(df, "text", 16, ["id"], normalize=False)
    assert "Generate" not in plan_of(out) and "explode" not in plan_of(out)
    wanted = {}
    for i, text in texts:
        v = wanted.setdefault(i, [0.0] * 16)
        for token in re.findall(r"\w+", (text or "").lower()):
            h = hashlib.md5(token.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += 1.0 if h[8] < "8" else -1.0
    assert {r.id: r.embedding for r in out.collect()} == wanted


def test_recall_of_several_key_columns_and_nulls(spark):
    schema = "n long, query_id long, rank int, id long"
    truth = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 6), (2, 1, 1, 5), (1, 3, 1, None), (1, None, 1, 5)], schema)
    pred = spark.createDataFrame([(1, 1, 1, 6), (1, 1, 2, 6), (1, 1, 3, 5), (1, 2, 1, 9), (1, 3, 1, None), (1, None, 1, 5)], schema)
    got = sorted(((r["n"], r.query_id or 0), r.recall) for r in M.recall_per_query(pred, truth, 2, ["n", "query_id"]).collect())
    assert got == [((1, 0), 0.0), ((1, 0), 0.0), ((1, 1), 0.5), ((1, 2), 0.0), ((1, 3), 0.0), ((2, 1), 0.0)]
