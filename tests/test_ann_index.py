"""Approximate searches: broadcast and shuffled strategies agree, scores are exact, vectors keep
their element type, and the product-quantised index is saved, reused and calibrated."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.operators import ann as A
from vecframe.operators import pq
from vecframe.operators import search as S
from vecframe.session import BROADCAST_BYTES_KEY

DIM = 20


def clustered(n=1500, clusters=12, seed=3, dim=DIM):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 4
    return centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim))


def frames(spark, X, kind="double", queries=None):
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], f"id long, embedding array<{kind}>").repartition(4)
    pick = range(len(X)) if queries is None else queries
    q = spark.createDataFrame([(int(i), X[i].tolist()) for i in pick], f"query_id long, query_vec array<{kind}>")
    return c, q


def plain(X, queries, k, metric):
    out = {}
    for i in queries:
        if metric == "l2":
            s = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
        else:
            length = np.linalg.norm(X, axis=1) * np.linalg.norm(X[i])
            s = -(X @ X[i]) / np.where(length > 0, length, 1.0)
        out[int(i)] = [int(j) for j in np.lexsort((np.arange(len(X)), s))[:k]]
    return out


def by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_strategies_agree(spark):
    X = clustered(400)
    c, q = frames(spark, X)
    cents = A.kmeans_centroids(c, "embedding", 6, max_iter=3)
    index = pq.PQIndex(pq.fit_pq(c, cells=8, subspaces=5), None)
    runs = [
        lambda: A.lsh_topk(c, q, 5, "cosine", bands=4, bits=4),
        lambda: A.lsh_topk(c, q, 5, "l2", bands=2, bits=9, exclude_self=True),  # few pairs: the sparse form
        lambda: A.ivf_topk(c, q, cents, 5, "l2", nprobe=2),
    ]
    small = [by_query(r()) for r in runs]
    spark.conf.set(BROADCAST_BYTES_KEY, "1000")  # beyond 16 blocks: shuffled by key
    try:
        assert [by_query(r()) for r in runs] == small
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert index.model.dim == DIM


def test_double_vectors_keep_their_precision(spark):
    base = np.ones(8)
    near = base.copy()
    near[0] += 1e-10
    X = np.stack([near, base, -base])
    c, q = frames(spark, X, queries=[1])
    for hits in (A.lsh_topk(c, q, 2, "l2", bands=2, bits=2), A.ivf_topk(c, q, A.kmeans_centroids(c, "embedding", 2), 2, "l2", nprobe=1)):
        rows = hits.orderBy("rank").collect()
        assert [r.id for r in rows] == [1, 0]
        assert rows[0].score == 0.0 and 0 < rows[1].score < 2e-10


def test_hot_key_is_scored_in_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_PAIRS", 500)
    X = clustered(300, clusters=1)
    scorer = A.KeyedScorer(lambda rows: np.zeros((len(rows), 1), np.int64), np.zeros((60, 1), np.int64), 5, "l2")
    found = scorer(X, np.arange(300), X[:60], np.arange(60))
    got = S.prune(found, 5, "l2").groupby("query_id")["id"].apply(list).to_dict()
    assert got == plain(X, range(60), 5, "l2")


# ---------------------------------------------------------------- binary codes


def plain_binary(X, queries, k, nc):
    signs = X >= 0
    out = {}
    for i in queries:
        d = (signs != signs[i]).sum(axis=1)
        cand = np.flatnonzero(d <= np.sort(d)[min(nc, len(X)) - 1])
        s = -(X[cand] @ X[i]) / np.linalg.norm(X[cand], axis=1) / np.linalg.norm(X[i])
        out[int(i)] = [int(j) for j in cand[np.lexsort((cand, s))[:k]]]
    return out


@pytest.mark.parametrize("dim", [20, 64, 130])
def test_binary_codes_against_plain_distances(spark, dim):
    X = clustered(250, dim=dim)
    c, q = frames(spark, X, "float")
    X32 = X.astype(np.float32).astype(np.float64)
    assert by_query(A.binary_topk(c, q, 4, num_candidates=15)) == plain_binary(X32, range(250), 4, 15)


def test_binary_codes_of_few_rows_nulls_and_bad_input(spark):
    X = clustered(6)
    c, q = frames(spark, X)
    more = c.unionByName(spark.createDataFrame([(99, None)], "id long, embedding array<double>"))
    assert by_query(A.binary_topk(more, q, 5)) == plain(X, range(6), 5, "cosine")
    assert A.binary_topk(c, q.limit(0), 5).count() == 0
    assert A.binary_topk(c.limit(0), q, 5).count() == 0
    with pytest.raises(ValueError):
        A.binary_topk(c, q, 5, num_candidates=4)


def test_binary_codes_by_join_and_in_blocks(spark, monkeypatch):
    X = clustered(200)
    c, q = frames(spark, X)
    wanted = plain_binary(X, range(200), 5, 20)
    monkeypatch.setattr(S, "MAX_BROADCAST_HITS", 10)
    assert by_query(A.binary_topk(c, q, 5, num_candidates=20)) == wanted
    spark.conf.set(BROADCAST_BYTES_KEY, "9000")  # four blocks
    try:
        assert by_query(A.binary_topk(c, q, 5, num_candidates=20)) == wanted
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


# ---------------------------------------------------------------- product quantisation


def recall(hits, wanted, k):
    got = by_query(hits)
    return np.mean([len(set(got.get(i, [])) & set(w)) / k for i, w in wanted.items()])


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_saved_index(spark, metric, tmp_path):
    X = clustered()
    X[7] = 0  # a zero vector is a row like any other
    c, q = frames(spark, X, queries=range(0, 1500, 5))
    path = f"{tmp_path}/index"
    assert not pq.has_pq(spark, path)
    built = pq.build_pq(c, pq.fit_pq(c, cells=12, subspaces=5, metric=metric), path)
    assert pq.has_pq(spark, path)
    assert len(glob.glob(f"{path}/rows/cell=*")) == 12
    index = pq.open_pq(spark, path)
    assert index.rows.count() == 1500
    assert np.array_equal(index.model.centres, built.model.centres)
    wanted = plain(X, range(0, 1500, 5), 5, metric)
    nprobe, rerank = pq.calibrate_pq(index, 5, 0.95)
    assert nprobe < 12 and rerank < 320
    hits = pq.pq_topk(index, q, 5, nprobe=nprobe, rerank=rerank)
    assert recall(hits, wanted, 5) >= 0.93
    everything = pq.pq_topk(index, q, 5, nprobe=12, rerank=1500)
    assert recall(everything, wanted, 5) > 0.999
    exact = {(r.query_id, r.id): r.score for r in S.exact_topk(c, q, 1500, metric).where("rank < 200").collect()}
    assert all(r.score == pytest.approx(exact[r.query_id, r.id], abs=1e-12) for r in hits.collect() if (r.query_id, r.id) in exact)
    plan = pq.pq_topk(index, q.limit(1), 5, nprobe=1, rerank=5)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan and "PartitionFilters: [isnotnull(cell#" in plan or "PartitionFilters: [cell#" in plan


def test_index_search_strategies_agree(spark, tmp_path):
    X = clustered(600)
    c, q = frames(spark, X)
    index = pq.build_pq(c, pq.fit_pq(c, cells=6, subspaces=4), f"{tmp_path}/i")
    search = lambda: by_query(pq.pq_topk(index, q, 5, nprobe=2, rerank=30))
    small = search()
    spark.conf.set(BROADCAST_BYTES_KEY, "1000")
    try:
        assert search() == small
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_index_on_bad_input(spark, tmp_path):
    X = clustered(50)
    c, q = frames(spark, X)
    with pytest.raises(ValueError):
        pq.fit_pq(c.limit(0), cells=4, subspaces=2)
    with pytest.raises(ValueError):
        pq.fit_pq(c, cells=4, subspaces=2, metric="ip")
    nan = c.unionByName(spark.createDataFrame([(77, [float("nan")] * DIM)], "id long, embedding array<double>"))
    index = pq.build_pq(nan, pq.fit_pq(nan, cells=400, subspaces=3), f"{tmp_path}/i")  # more cells than rows
    assert index.rows.count() == 50
    assert by_query(pq.pq_topk(index, q, 5, nprobe=1000, rerank=50)) == plain(X, range(50), 5, "cosine")
    assert pq.pq_topk(index, q.limit(0), 5, nprobe=1, rerank=5).count() == 0
    with pytest.raises(ValueError):
        pq.pq_topk(index, q, 5, nprobe=1, rerank=4)
    short = q.withColumn("query_vec", F.slice("query_vec", 1, 3))
    with pytest.raises(ValueError):
        pq.pq_topk(index, short, 5, nprobe=1, rerank=5)


def test_sweep_over_bands(spark):
    X = clustered(120)
    c, q = frames(spark, X, queries=range(0, 120, 7))
    hits = S.size_sweep_topk(c, q, [30, 60, 90, 120], 4, "cosine").collect()
    assert len(hits) == 4 * 4 * 18
    for n in (30, 60, 90, 120):
        for i, order in plain(X, range(0, 120, 7), 120, "cosine").items():
            assert [r.id for r in sorted(hits, key=lambda r: r.rank) if r.n == n and r.query_id == i] == [j for j in order if j < n][:4]
    bands = S._band_candidates(c.select("id", F.col("embedding").alias("vec")), S.query_blocks(q, 10**9)[0][0], [30, 60, 90, 120], 200, "cosine")
    assert bands.count() == 120 * 18  # every pair scored once, whatever the number of sizes
