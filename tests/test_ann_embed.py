import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.functions import embed as E
from vecframe.functions import vectors as V
from vecframe.operators import ann as A
from vecframe.operators import metrics as M
from vecframe.operators import search as S

SF01 = "/root/testdata/sf0.01"


def table(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return c, q


def test_ann_scores_are_exact_and_recall_above_floor(spark):
    c, q = table(spark)
    truth = S.exact_topk(c, q, 5, "cosine")
    exact_scores = {(r.query_id, r.id): r.score for r in
                    S.exact_topk(c, q, 500, "cosine").collect()}
    for name, hits, floor in [
        ("lsh", A.lsh_topk(c, q, 5, "cosine", bands=8, bits=4), 0.6),
        ("ivf", A.ivf_topk(c, q, A.label_centroids(c, "label", "embedding"), 5, "cosine", nprobe=2), 0.3),
        ("two", A.twostage_topk(c, q, 5, "cosine", num_candidates=50, prefix_dims=32), 0.6),
    ]:
        rows = hits.collect()
        for r in rows:
            assert r.score == pytest.approx(exact_scores[(r.query_id, r.id)], abs=1e-9), name
        rec = M.recall_summary(M.recall_per_query(hits, truth, 5)).first()
        assert rec.recall_at_k >= floor, (name, rec.recall_at_k)
        assert all(r.rank <= 5 for r in rows)


def test_lsh_hyperplanes_deterministic():
    a = A.hyperplanes(4, 8)
    assert np.array_equal(a, A.hyperplanes(4, 8)) and set(np.unique(a)) <= {-1.0, 1.0}


def test_kmeans_centroids_shape(spark):
    c, _ = table(spark)
    cents = A.kmeans_centroids(c, "embedding", 4, max_iter=3).collect()
    assert len(cents) == 4 and len(cents[0].centroid) == 64


def test_hash_embed_unit_and_zero(spark):
    df = spark.createDataFrame([(1, "Hello hello WORLD"), (2, "!!!"), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in E.hash_embed(df, "text", 16).collect()}
    assert len(got) == 3 and len(got[1]) == 16
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12
    assert not any(got[2]) and not any(got[3])
    raw = {r.id: r.embedding for r in E.hash_embed(df, "text", 16, normalize=False).collect()}
    assert sum(abs(x) for x in raw[1]) <= 3 and all(float(x).is_integer() for x in raw[1])


def test_pluggable_embedder(spark):
    class CharCount:  # defined locally so it is shipped to the workers by value
        dim = 3

        def embed(self, texts):
            return [[len(t), t.count("a"), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "banana"), (2, "")], "id long, text string")
    got = {r.id: list(r.embedding) for r in E.embed_with(df, "text", CharCount, 3).collect()}
    assert got == {1: [6.0, 3.0, 1.0], 2: [0.0, 0.0, 1.0]}


def test_sql_functions_match_column_functions(spark):
    V.register_sql_functions(spark)
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0])], "a array<float>, b array<float>")
    df.createOrReplaceTempView("vv")
    r = spark.sql("SELECT inner_product(a, b) ip, cosine_similarity(a, b) cs, l2_distance(a, b) l2, "
                  "l2_normalize(a) n FROM vv").first()
    c = df.select(V.inner_product("a", "b").alias("ip"), V.cosine_similarity("a", "b").alias("cs"),
                  V.l2_distance("a", "b").alias("l2"), V.l2_normalize("a").alias("n")).first()
    assert r.ip == c.ip == 4.0 and r.cs == pytest.approx(c.cs) and r.l2 == pytest.approx(c.l2)
    assert r.n == pytest.approx([1 / 3, 2 / 3, 2 / 3]) and c.n == pytest.approx(r.n)
    assert df.select(V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first().z == [0.0, 0.0]


def test_dir_usage(spark, tmpdir_path):
    import os

    os.makedirs(os.path.join(tmpdir_path, "a"))
    with open(os.path.join(tmpdir_path, "a", "f.bin"), "wb") as f:
        f.write(b"x" * 1048576)
    assert M.dir_usage_mb(spark, tmpdir_path) == pytest.approx(1.0)
    assert M.dir_usage_mb(spark, os.path.join(tmpdir_path, "missing")) is None


def test_hash_embed_wide_and_sparse_paths_agree_with_counts(spark):
    df = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "Delta, delta! 42"), (3, "")], "id long, text string")
    for dim in (16, 128):  # one aggregate per text / (text, bucket) assembly
        dense = {r.id: r.embedding for r in E.hash_embed(df, "text", dim, normalize=False).collect()}
        counts = E.hash_counts(df, "text", dim).collect()
        want = {i: [0.0] * dim for i in (1, 2, 3)}
        for r in counts:
            want[r.id][r.bucket] = float(r.cnt)
        assert dense == want


def test_chunk_text_from_sql(spark):
    from vecframe.functions.text import chunk_text

    V.register_sql_functions(spark)
    rows = [(1, "  abcdefghij klmnopqrst  "), (2, None), (3, ""), (4, "x" * 35), (5, "\t \n"), (6, "ab  " * 9)]
    spark.createDataFrame(rows, "k long, body string").createOrReplaceTempView("chunk_docs")
    got = spark.sql("SELECT k, chunk_ix, chunk FROM chunk_docs, LATERAL chunk_text(body, 10, 3)").collect()
    want = chunk_text(spark.table("chunk_docs"), "body", 10, 3, keep=["k"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_vector_query_side(spark):
    from vecframe.sources import corpus as C

    df = spark.createDataFrame([(i, [1.0 * i], None if i % 2 else [2.0 * i]) for i in range(6)], "k long, train array<float>, test array<float>")
    assert [r.query_id for r in C.vector_queries(df, "k", max_queries=2).orderBy("query_id").collect()] == [0, 2]
    assert C.vector_queries(df, "k", query_key="train").count() == 6
    assert C.corpus_column(df.withColumnsRenamed({"train": "a", "test": "b"}).select("b", "a")) == "a"
    assert C.vector_queries(df.drop("test"), "k").count() == 6
    with pytest.raises(ValueError):
        C.vector_queries(df, "k", query_key="nope")
