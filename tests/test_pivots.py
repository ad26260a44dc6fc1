import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ann_index import by_query, clustered, frames, plain

from vecframe.operators import pivots as P
from vecframe.session import BROADCAST_BYTES_KEY


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_clustered_and_random_vectors(spark, metric):
    rng = np.random.default_rng(9)
    for X, most in ((clustered(900), 0.35), (rng.normal(size=(500, 6)) * 1e6 + 1e7, 1.0)):
        X[3] = 0
        X[11] = X[12] = X[13]  # ties
        c, q = frames(spark, X, queries=range(0, 500, 4))
        join = P.pivot_join(c, q, 5, metric)
        assert by_query(join.hits) == plain(X, range(0, 500, 4), 5, metric)
        assert join.all_pairs == len(X) * 125 and join.pairs <= most * join.all_pairs


def test_more_answers_than_rows_and_self(spark):
    X = clustered(12)
    c, q = frames(spark, X)
    assert by_query(P.pivot_topk(c, q, 50, "l2")) == plain(X, range(12), 12, "l2")
    others = {i: [j for j in w if j != i][:3] for i, w in plain(X, range(12), 12, "l2").items()}
    assert by_query(P.pivot_topk(c, q, 3, "l2", exclude_self=True)) == others


def test_blocks_of_queries(spark):
    X = clustered(300)
    c, q = frames(spark, X, "float")
    X = X.astype(np.float32).astype(np.float64)
    spark.conf.set(BROADCAST_BYTES_KEY, "9000")
    try:
        assert by_query(P.pivot_topk(c, q, 4, "cosine")) == plain(X, range(300), 4, "cosine")
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)


def test_bad_input(spark):
    X = clustered(20)
    c, q = frames(spark, X)
    assert P.pivot_topk(c.limit(0), q, 3).count() == 0
    assert P.pivot_topk(c, q.limit(0), 3).count() == 0
    nan = c.unionByName(spark.createDataFrame([(77, [float("nan")] * X.shape[1])], "id long, embedding array<double>"))
    odd = q.unionByName(spark.createDataFrame([(78, [float("inf")] * X.shape[1])], "query_id long, query_vec array<double>"))
    assert by_query(P.pivot_topk(nan, odd, 3, "l2")) == plain(X, range(20), 3, "l2")
    same = c.withColumn("embedding", F.array(*[F.lit(1.0)] * 3))
    hits = P.pivot_topk(same, same.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 2, "cosine")
    assert all(ids == [0, 1] for ids in by_query(hits).values())
    with pytest.raises(ValueError):
        P.pivot_topk(c, q, 3, "ip")
    with pytest.raises(ValueError):
        P.pivot_topk(c, q, 0)
