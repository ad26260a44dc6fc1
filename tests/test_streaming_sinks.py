import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.functions.embed import hash_embed
from vecframe.sources import sinks as K
from vecframe.streaming.rag import TURN_SCHEMA, start_stream_rag
from vecframe.streaming.upsert import list_versions, read_current, start_stream_upsert

SRC = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()),
                    T.StructField("text", T.StringType())])


def test_stream_upsert(spark, tmpdir_path):
    src, store, ck = (os.path.join(tmpdir_path, x) for x in ("src", "store", "ck"))
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "b2")], SRC).write.mode("append").parquet(src)
    q = start_stream_upsert(spark, src, SRC, store, ck)
    q.awaitTermination()
    store_schema = T.StructType([SRC["id"], SRC["text"]])
    assert dict(read_current(spark, store, store_schema).collect()) == {1: "a", 2: "b2"}
    spark.createDataFrame([(2, 3, "b3"), (3, 1, "c")], SRC).write.mode("append").parquet(src)
    q = start_stream_upsert(spark, src, SRC, store, ck)
    q.awaitTermination()
    assert dict(read_current(spark, store, store_schema).collect()) == {1: "a", 2: "b3", 3: "c"}
    assert len(list_versions(spark, store)) == 2


def test_stream_rag(spark, tmpdir_path):
    src, out, state, ck = (os.path.join(tmpdir_path, x) for x in ("q", "out", "state", "ck"))
    corpus = spark.createDataFrame([(1, "vector databases store embeddings", "db"),
                                    (2, "cats sleep all day long", "pets")], "id long, text string, topic string")
    vecs = hash_embed(corpus, "text", 64, ["id"], normalize=False)
    turns1 = [(7, 0, "user", "where are embeddings stored"), (7, 1, "assistant", "ignored"),
              (8, 0, "user", "exit"), (9, 0, "user", "  ")]
    spark.createDataFrame(turns1, TURN_SCHEMA).write.mode("append").parquet(src)
    q = start_stream_rag(spark, src, vecs, corpus.select("id", "topic", "text"), out, state, ck, k=1)
    q.awaitTermination()
    spark.createDataFrame([(8, 1, "user", "do cats sleep"), (7, 2, "user", "cats?")], TURN_SCHEMA).write.mode("append").parquet(src)
    q = start_stream_rag(spark, src, vecs, corpus.select("id", "topic", "text"), out, state, ck, k=1)
    q.awaitTermination()
    got = {(r.conv_id, r.turn): r.prompt for r in spark.read.parquet(out).collect()}
    assert set(got) == {(7, 0), (7, 2)}  # conversation 8 stopped in an earlier batch
    assert "[Source 1 | topic=db] vector databases store embeddings" in got[(7, 0)]
    assert "topic=pets" in got[(7, 2)]


def test_sinks(spark, tmpdir_path):
    runs = spark.createDataFrame([("a", 1.5, 3), ("b", 2.0, 4)], "db string, avg_ms double, n long")
    K.write_report(runs, os.path.join(tmpdir_path, "rep"), "20240101_000000")
    text = spark.read.text(os.path.join(tmpdir_path, "rep")).first().value
    doc = json.loads(text)
    assert doc["timestamp"] == "20240101_000000" and len(doc["results"]) == 2
    assert len(K.report_rows(runs).collect()) == 2
    paths = [os.path.join(tmpdir_path, "csv1"), os.path.join(tmpdir_path, "csv2")]
    K.publish_csv(runs, paths)
    for p in paths:
        files = [f for f in os.listdir(p) if f.endswith(".csv")]
        assert len(files) == 1
        assert open(os.path.join(p, files[0])).read().splitlines()[0] == "db,avg_ms,n"
    docs = spark.createDataFrame([(0, " first "), (1, "   "), (2, "third")], "pos long, text string")
    named = K.export_texts(docs, "pos", "text", max_docs=2)
    assert [tuple(r) for r in named.collect()] == [("doc_000000.txt", "first")]
    K.write_texts(K.export_texts(docs, "pos", "text"), os.path.join(tmpdir_path, "export"))
    folders = sorted(f for f in os.listdir(os.path.join(tmpdir_path, "export")) if f.startswith("name="))
    assert folders == ["name=doc_000000.txt", "name=doc_000002.txt"]


def test_old_versions_are_removed(spark, tmpdir_path):
    from vecframe.streaming import upsert as U

    for v in range(5):
        spark.range(v + 1).write.parquet(U.version_path(tmpdir_path, v))
    U.drop_old_versions(spark, tmpdir_path)
    assert U.list_versions(spark, tmpdir_path) == [3, 4]
