import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.operators import search as S

SCHEMA_C = "id long, embedding array<float>"
SCHEMA_Q = "query_id long, query_vec array<float>"


def brute(corpus, queries, k, metric):
    out = []
    for qid, q in queries:
        q = np.asarray(q, dtype=np.float64)
        scored = []
        for cid, v in corpus:
            v = np.asarray(v, dtype=np.float64)
            if metric == "l2":
                s = float(np.sqrt(((v - q) ** 2).sum()))
            elif metric == "ip":
                s = float(v @ q)
            else:
                den = np.linalg.norm(v) * np.linalg.norm(q)
                s = float(v @ q / den) if den > 0 else 0.0
            scored.append((s, cid))
        scored.sort(key=lambda t: (t[0] if metric == "l2" else -t[0], t[1]))
        out += [(qid, r + 1, cid, round(s, 9)) for r, (s, cid) in enumerate(scored[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def random_rows(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_exact_topk_matches_brute_force(spark, metric, strategy):
    corpus = random_rows(120, 8, 1)
    queries = random_rows(15, 8, 2)
    c = spark.createDataFrame(corpus, SCHEMA_C).repartition(5)
    q = spark.createDataFrame(queries, SCHEMA_Q)
    if strategy == "grid":
        spark.conf.set("vecframe.search.blockRows", "16")  # forces many salted blocks
    try:
        got = rows(S.exact_topk(c, q, 4, metric, strategy=strategy))
    finally:
        spark.conf.unset("vecframe.search.blockRows")
    assert got == brute(corpus, queries, 4, metric)


def test_ties_break_by_id_and_partitioning_does_not_matter(spark):
    corpus = [(7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [2.0, 0.0]), (1, [0.0, 1.0])]
    q = spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA_Q)
    for parts in (1, 4):
        c = spark.createDataFrame(corpus, SCHEMA_C).repartition(parts)
        got = [(r.rank, r.id) for r in S.exact_topk(c, q, 3, "cosine").orderBy("rank").collect()]
        assert got == [(1, 3), (2, 5), (3, 7)]


def test_k_greater_than_n_and_empty_corpus(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA_C)
    q = spark.createDataFrame([(0, [1.0, 1.0])], SCHEMA_Q)
    assert S.exact_topk(c, q, 10, "cosine").count() == 2
    empty = spark.createDataFrame([], SCHEMA_C)
    assert S.exact_topk(empty, q, 5, "cosine").count() == 0


def test_zero_vector_scores_zero(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], SCHEMA_C)
    q = spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA_Q)
    got = {r.id: r.score for r in S.exact_topk(c, q, 2, "cosine").collect()}
    assert got == {2: pytest.approx(1.0), 1: 0.0}


def test_invalid_query_vectors_raise(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA_C)
    with pytest.raises(ValueError):
        S.exact_topk(c, spark.createDataFrame([(0, [])], SCHEMA_Q), 1)
    with pytest.raises(ValueError):
        S.exact_topk(c, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], SCHEMA_Q), 1)
    with pytest.raises(ValueError):
        S.exact_topk(c, spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA_Q), 1, "hamming")


def test_wrong_corpus_dimension_fails(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], SCHEMA_C)
    q = spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA_Q)
    with pytest.raises(Exception):
        S.exact_topk(c, q, 1).collect()


def test_exclude_self_and_fallback(spark):
    corpus = random_rows(40, 4, 3)
    c = spark.createDataFrame(corpus, SCHEMA_C)
    q = c.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = S.exact_topk(c, q, 3, "cosine", exclude_self=True)
    assert hits.filter("id = query_id").count() == 0
    assert hits.count() == 40 * 3
    primary = hits.filter("query_id < 10")
    out = S.search_with_fallback(primary, hits)
    assert out.count() == 120
    assert out.filter("source = 'primary'").count() == 30


def test_size_sweep_equals_separate_searches(spark):
    corpus = random_rows(50, 6, 4)
    c = spark.createDataFrame(corpus, SCHEMA_C)
    q = spark.createDataFrame(random_rows(4, 6, 5), SCHEMA_Q)
    sweep = S.size_sweep_topk(c, q, [10, 50], 3, "cosine")
    for n in (10, 50):
        alone = rows(S.exact_topk(c.filter(F.col("id") < n), q, 3, "cosine"))
        part = rows(sweep.filter(F.col("n") == n).drop("n"))
        assert part == alone


def test_lookup_payload_keeps_missing_ids(spark):
    hits = spark.createDataFrame([(0, 1, 5, 0.9), (0, 2, 6, 0.8)], "query_id long, rank int, id long, score double")
    docs = spark.createDataFrame([(5, "five")], "doc_id long, text string")
    for bound in (None, 2):
        got = {r.id: r.text for r in S.lookup_payload(hits, docs, "doc_id", {"text": "text"}, bound).collect()}
        assert got == {5: "five", 6: None}


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_float32_candidates_never_lose_near_ties(spark, metric):
    rng = np.random.default_rng(11)
    d = 512
    base = rng.normal(size=(60, d))
    # many rows that differ from each other by ~1e-7: their float32 scores collide
    near = base[0] + rng.normal(scale=1e-7, size=(40, d))
    X = np.vstack([base, near])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(X)]
    Qm = np.vstack([base[0], rng.normal(size=d)])
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(Qm)]
    c = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    got = S.exact_topk(c, q, 7, metric).collect()
    for qi, qv in enumerate(Qm):
        if metric == "cosine":
            true = (X @ qv) / (np.linalg.norm(X, axis=1) * np.linalg.norm(qv))
        else:
            true = X @ qv
        kth = np.sort(true)[::-1][6]
        mine = [r.id for r in got if r.query_id == qi]
        assert len(mine) == 7
        # every returned row is a true top-7 row (up to float64 rounding of equal scores)
        assert all(true[i] >= kth - 1e-12 * max(1.0, abs(kth)) for i in mine)


# --- answers do not depend on size, strategy or batch layout


def _searches(spark, c, q, k, metric):
    """The same search by every strategy and with tiny bounds."""
    yield S.exact_topk(c, q, k, metric, strategy="broadcast")
    yield S.exact_topk(c, q, k, metric, strategy="grid")
    for bound in ("64", "1000"):
        spark.conf.set("vecframe.search.broadcastBytes", bound)
        try:
            yield S.exact_topk(c, q, k, metric)
        finally:
            spark.conf.unset("vecframe.search.broadcastBytes")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_non_finite_rows_take_no_part(spark, metric):
    nan, inf = float("nan"), float("inf")
    good = random_rows(6, 4, 3)
    bad = [(100 + i, [nan, 1.0, 2.0, 3.0]) for i in range(7)] + [(200, [inf, 0.0, 0.0, 0.0])]
    queries = random_rows(3, 4, 4)
    q = spark.createDataFrame(queries + [(77, [nan, 0.0, 0.0, 1.0])], SCHEMA_Q)
    for parts in (1, 8):
        c = spark.createDataFrame(bad + good, SCHEMA_C).repartition(parts)
        for found in _searches(spark, c, q, 5, metric):
            assert rows(found) == brute(good, queries, 5, metric)


@pytest.mark.parametrize("vector", [[1.0, None], None, [1.0]])
def test_null_elements_raise_on_every_path(spark, vector):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, vector)], SCHEMA_C)
    q = spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA_Q)
    for strategy in ("broadcast", "grid"):
        with pytest.raises(Exception, match="vector"):
            S.exact_topk(c, q, 2, "cosine", strategy=strategy).collect()
    with pytest.raises(Exception, match="vector"):
        S.exact_topk(c.where("id = 1"), spark.createDataFrame([(0, vector), (1, [1.0, 2.0])], SCHEMA_Q), 2).collect()


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_far_from_the_origin_no_neighbour_is_lost(spark, metric):
    rng = np.random.default_rng(5)
    x = (1e4 + 1e-3 * rng.normal(size=(600, 16))).astype(np.float32).astype(float)
    corpus = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = corpus[:20]
    c = spark.createDataFrame(corpus, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    want = {}
    for qid, v in queries:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        want[qid] = sorted(zip(np.round(d, 12), range(len(x))))[:5]
    for strategy in ("broadcast", "grid"):
        got = S.exact_topk(c, q, 5, metric, strategy=strategy).orderBy("query_id", "rank").collect()
        assert len(got) == 100
        if metric == "l2":
            for qid in want:
                assert [r.id for r in got if r.query_id == qid] == [i for _, i in want[qid]]


def test_huge_and_tiny_inner_products(spark):
    corpus = [(1, [1e30, 0.0]), (2, [5e29, 1.0]), (3, [1e-30, 0.0]), (4, [2e-30, 0.0])]
    queries = [(0, [1e30, 1.0]), (1, [1e-30, 0.0])]
    c = spark.createDataFrame(corpus, "id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    for found in _searches(spark, c, q, 2, "ip"):
        assert [(r.query_id, r.id) for r in found.orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_size_sweep_takes_any_number_of_queries(spark):
    corpus, queries = random_rows(60, 4, 6), random_rows(25, 4, 7)
    c, q = spark.createDataFrame(corpus, SCHEMA_C).repartition(4), spark.createDataFrame(queries, SCHEMA_Q)
    spark.conf.set("vecframe.search.broadcastBytes", "100")
    try:
        got = S.size_sweep_topk(c, q, [20, 60], 3, "cosine").collect()
    finally:
        spark.conf.unset("vecframe.search.broadcastBytes")
    for n in (20, 60):
        assert sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in got if r.n == n) == brute(corpus[:n], queries, 3, "cosine")


def test_payload_side_is_not_shuffled(spark):
    hits = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 0.4), (1, 1, 5000, 0.1)], "query_id long, rank int, id long, score double")
    side = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.lookup_payload(hits, side, "doc_id", {"text": "text"}, max_hit_rows=3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = {(r.query_id, r.rank, r.text) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(0, 1, "text 5"), (0, 2, "text 6"), (1, 1, None)}
    below = plan[: plan.index("Range")]
    assert "BroadcastHashJoin" in below and below.rindex("BroadcastHashJoin") > below.rindex("Exchange hashpartitioning")


def test_small_keys_are_packed_to_bounded_groups(spark):
    rows_per_key, n_keys, B = 2, 3000, 64
    c = spark.range(rows_per_key * n_keys).selectExpr("id", "id % 3000 as key", "array(1.0, cast(id as double)) as vec")
    q = spark.range(n_keys).selectExpr("id as query_id", "id as key", "array(1.0, 0.0) as query_vec")
    sides = S.salted_sides(c, q, ["key"], B)
    _, right = S.packed(*sides, ["key"], B, rows_per_key * n_keys)
    sizes = [r["count"] for r in right.groupBy("_g", "_qs", "_cs").count().collect()]
    assert max(sizes) <= 4 * B and sum(sizes) == rows_per_key * n_keys


def test_fallback_searches_only_unanswered_queries(spark):
    corpus, queries = random_rows(30, 4, 8), random_rows(6, 4, 9)
    c, q = spark.createDataFrame(corpus, SCHEMA_C), spark.createDataFrame(queries, SCHEMA_Q)
    primary = S.exact_topk(c, q.where("query_id < 4"), 2, "cosine")
    asked = []

    def fallback(rest):
        asked.extend(r.query_id for r in rest.collect())
        return S.exact_topk(c, rest, 2, "cosine")

    out = S.search_with_fallback(primary, fallback, q)
    assert sorted(asked) == [4, 5]
    assert {(r.query_id, r.source) for r in out.collect()} == {(i, "primary" if i < 4 else "fallback") for i in range(6)}
