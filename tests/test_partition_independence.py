"""The same result with 1 and with 8 input partitions."""

from vecframe.functions import embed as E
from vecframe.functions import text as X
from vecframe.operators import ingest as I

DOCS = "/root/testdata/sf0.01/documents.parquet"
TURNS = "/root/testdata/sf0.01/conversations.parquet"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_upsert(spark):
    docs = spark.read.parquet(DOCS).selectExpr("doc_id AS id", "text")
    turns = spark.read.parquet(TURNS).selectExpr("conv_id AS id", "turn AS seq", "text")
    one = I.upsert_last_wins(docs.repartition(1), turns.repartition(1), "id", "seq")
    many = I.upsert_last_wins(docs.repartition(8), turns.repartition(8), "id", "seq")
    assert same(one, many)


def test_hash_embed_and_chunks(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    assert same(E.hash_embed(docs.repartition(1), "text", 64, ["doc_id"]),
                E.hash_embed(docs.repartition(8), "text", 64, ["doc_id"]))
    assert same(X.chunk_text(docs.repartition(1), "text", 1000, 150, keep=["doc_id"]),
                X.chunk_text(docs.repartition(8), "text", 1000, 150, keep=["doc_id"]))
