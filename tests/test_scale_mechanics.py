import numpy as np
from pyspark.sql import functions as F

from vecframe.operators import search as S
from vecframe.session import spread


def test_hot_key_is_split_into_bounded_groups(spark):
    # key 0 holds 90% of the corpus and of the queries
    rng = np.random.default_rng(7)
    corpus = [(i, 0 if i % 10 else 1, [float(x) for x in rng.normal(size=4)]) for i in range(2000)]
    queries = [(i, 0 if i % 10 else 1, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    c = spark.createDataFrame(corpus, "id long, key int, vec array<double>")
    q = spark.createDataFrame(queries, "query_id long, key int, query_vec array<double>")
    B = 100
    qs, cs = S.salted_sides(c, q, ["key"], B, max_keys=2)
    sizes_c = [r["count"] for r in cs.groupBy("key", "_qs", "_cs").count().collect()]
    sizes_q = [r["count"] for r in qs.groupBy("key", "_qs", "_cs").count().collect()]
    assert max(sizes_c) <= 2 * B and max(sizes_q) <= 2 * B
    assert len(sizes_c) > 20  # the hot key became many groups
    # the result equals per-key brute force
    got = {(r.query_id, r.rank): r.id for r in S.knn_within_keys(c, q, ["key"], 3, "ip", block_rows=B, max_keys=2).collect()}
    C = {i: (k, np.array(v)) for i, k, v in corpus}
    for qid, key, v in queries[:40]:
        cand = sorted(((-(C[i][1] @ np.array(v)), i) for i in C if C[i][0] == key))[:3]
        assert [got[(qid, r)] for r in (1, 2, 3)] == [i for _, i in cand]


def test_spread_only_when_input_is_narrow(spark):
    slots = spark.sparkContext.defaultParallelism
    one_file = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert spread(one_file).rdd.getNumPartitions() == slots
    shuffled = one_file.groupBy("lang").count()
    assert spread(shuffled) is shuffled
    wide = spark.range(0, 1000, numPartitions=slots * 2)
    assert spread(wide) is wide


def test_empty_query_table(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([], "query_id long, query_vec array<float>")
    assert S.exact_topk(c, q, 3).count() == 0
