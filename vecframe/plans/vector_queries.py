"""Registered vector-scalar (V1-V5) and collection-maintenance (K5-K10) queries, and the
text ground truth (T7) of the benchmark questions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecframe.functions import embed as E
from vecframe.functions import vectors as V
from vecframe.operators import ingest as I
from vecframe.operators import search as S
from vecframe.plans.registry import register
from vecframe.plans.tables import table

DIM = 64


def pairs(spark, sf_dir):
    """Each vector with its successor id (an equi-join, linear in the table); a vector
    without a successor is its own partner, so every row of the table is scored."""
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    both = e.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id", "left")
    return both.select("vec_id", "a", F.coalesce("next_id", "vec_id").alias("next_id"), F.coalesce("b", "a").alias("b"))


_PAIRS_SQL = """p AS (
  SELECT x.vec_id, coalesce(y.vec_id, x.vec_id) AS next_id, CAST(x.embedding AS DOUBLE[]) AS a,
         CAST(coalesce(y.embedding, x.embedding) AS DOUBLE[]) AS b
  FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1)"""


@register("l2_normalize", """
SELECT vec_id, unnest(range(0, len(v))) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS value
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    """V1: unit vectors, one row per element."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "value"))


@register("inner_product", f"WITH {_PAIRS_SQL} SELECT vec_id, next_id, list_dot_product(a, b) AS score FROM p")
def inner_product(spark, sf_dir):
    """V2: inner product of each vector with the next one."""
    return pairs(spark, sf_dir).select("vec_id", "next_id", V.inner_product("a", "b").alias("score"))


@register("cosine_similarity", f"""WITH {_PAIRS_SQL}
SELECT vec_id, next_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS score FROM p""")
def cosine_similarity(spark, sf_dir):
    """V3: cosine similarity with the next vector."""
    return pairs(spark, sf_dir).select("vec_id", "next_id", V.cosine_similarity("a", "b").alias("score"))


@register("l2_distance", f"WITH {_PAIRS_SQL} SELECT vec_id, next_id, list_distance(a, b) AS score FROM p")
def l2_distance(spark, sf_dir):
    """V4: Euclidean distance to the next vector (the SQL ``<->`` operator)."""
    return pairs(spark, sf_dir).select("vec_id", "next_id", V.l2_distance("a", "b").alias("score"))


@register("vector_profile", """
SELECT label, count(*) AS n, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max,
       count(*) FILTER (WHERE embedding IS NULL) AS n_null,
       count(*) FILTER (WHERE list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))) AS n_bad,
       min(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS norm_min,
       max(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS norm_max,
       'vec_' || CAST(min(vec_id) AS VARCHAR) || '...' AS first_preview
FROM embeddings GROUP BY label""")
def vector_profile(spark, sf_dir):
    """V5 (+S10, P11): count, dimension range, NULL / ill-typed vectors and norms per label."""
    from vecframe.functions.text import preview

    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).alias("dim_min"),
        F.max(F.size("embedding")).alias("dim_max"),
        F.count(F.when(F.col("embedding").isNull(), 1)).alias("n_null"),
        F.count(F.when(V.has_bad_element("embedding"), 1)).alias("n_bad"),
        F.min(V.norm("embedding")).alias("norm_min"),
        F.max(V.norm("embedding")).alias("norm_max"),
        preview(F.concat(F.lit("vec_"), F.min("vec_id").cast("string")), 50).alias("first_preview"),
    )


# ------------------------------------------------------------------ ingest

def base_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def batch_turns(spark, sf_dir):
    """An update batch keyed by conversation: every turn is a version of the row."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "text")


@register("upsert_last_wins", """
WITH latest AS (SELECT conv_id AS id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, text FROM latest""")
def upsert_last_wins(spark, sf_dir):
    """K5: documents upserted with a conversation batch; the last turn of a key wins."""
    return I.upsert_last_wins(base_docs(spark, sf_dir), batch_turns(spark, sf_dir), "id", "seq")


@register("store_upsert", """
WITH latest AS (SELECT conv_id AS id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, text FROM latest""")
def store_upsert(spark, sf_dir):
    """K5 in a stored collection: the documents as its base, the conversations upserted in two
    batches (each one's last turn in the second), and the collection read back."""
    import uuid

    from vecframe.session import ensure_checkpoint_dir
    from vecframe.streaming.store import KeyedStore

    base = base_docs(spark, sf_dir)
    store = KeyedStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", "id", base.schema, buckets=16)
    store.create(base)
    turns = batch_turns(spark, sf_dir)
    last = turns.groupBy("id").agg(F.max("seq").alias("seq"))
    store.upsert(turns.join(last, ["id", "seq"], "left_anti"), "seq", 1)  # all but each last turn
    store.upsert(turns.join(last, ["id", "seq"], "left_semi"), "seq", 2)
    return store.read()


@register("append_insert", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id, text FROM conversations")
def append_insert(spark, sf_dir):
    """K6: plain append; duplicate keys kept."""
    return I.append_insert(base_docs(spark, sf_dir), batch_turns(spark, sf_dir).drop("seq"))


@register("insert_ignore", """
WITH firsts AS (SELECT conv_id AS id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id AS id, text FROM documents
UNION ALL SELECT id, text FROM firsts WHERE id NOT IN (SELECT doc_id FROM documents)""")
def insert_ignore(spark, sf_dir):
    """K7: keyed insert that leaves existing keys alone."""
    return I.insert_ignore(base_docs(spark, sf_dir), batch_turns(spark, sf_dir), "id", "seq")


@register("insert_conflicts", """
SELECT conv_id AS id, turn AS seq, text FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)""")
def insert_conflicts(spark, sf_dir):
    """K7: batch rows whose key already exists."""
    return I.insert_conflicts(base_docs(spark, sf_dir), batch_turns(spark, sf_dir), "id")


@register("batch_plan", """
SELECT batch_id, count(*) AS rows, min(doc_id) AS first_key, max(doc_id) AS last_key
FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch_id FROM documents) GROUP BY batch_id""")
def batch_plan(spark, sf_dir):
    """K8: write batches of 256 documents in key order."""
    return I.batch_plan(table(spark, sf_dir, "documents"), "doc_id", 256)


# The violation reasons reported by the vector validation.
REASONS = ["null_id", "null_text", "null_embedding", "wrong_dim", "bad_element", "duplicate_key"]


@register("validate_vectors", """
WITH v AS (
  SELECT e.vec_id, e.embedding, d.text, count(*) OVER (PARTITION BY e.vec_id) AS cnt
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
bad AS (
  SELECT 'null_id' AS reason FROM v WHERE vec_id IS NULL
  UNION ALL SELECT 'null_text' FROM v WHERE text IS NULL
  UNION ALL SELECT 'null_embedding' FROM v WHERE embedding IS NULL
  UNION ALL SELECT 'wrong_dim' FROM v WHERE embedding IS NOT NULL AND len(embedding) <> 64
  UNION ALL SELECT 'bad_element' FROM v
    WHERE embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))
  UNION ALL SELECT 'duplicate_key' FROM v WHERE cnt > 1),
r AS (SELECT unnest(['null_id', 'null_text', 'null_embedding', 'wrong_dim', 'bad_element', 'duplicate_key']) AS reason)
SELECT r.reason, count(bad.reason) AS n FROM r LEFT JOIN bad ON bad.reason = r.reason GROUP BY r.reason""")
def validate_vectors(spark, sf_dir):
    """Violations of the declared vector schema (64-d, NOT NULL text/vector, unique
    key) counted per reason; a clean table reports zeros."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    bad = I.validate_vectors(e.join(d, "vec_id", "left"), "vec_id", "embedding", DIM, text_col="text")
    reasons = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    counts = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.join(F.broadcast(counts), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ text ground truth

def hash_dense_sql(prefix: str, id_col: str, tbl: str, dim: int = DIM) -> str:
    """DuckDB CTEs for the dense hash count vectors ``{prefix}dense(id, v)`` of a table."""
    p = prefix
    return f"""{p}t AS (SELECT {id_col} AS id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {tbl}),
{p}f AS (SELECT id, md5(tok) AS h FROM {p}t WHERE length(tok) > 0),
{p}c AS (
  SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {dim} AS BIGINT) AS bucket,
         sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS cnt
  FROM {p}f GROUP BY ALL),
{p}w AS (SELECT id, bucket, cnt FROM {p}c WHERE cnt <> 0),
{p}dense AS (
  SELECT s.{id_col} AS id, list(CAST(coalesce(w.cnt, 0) AS DOUBLE) ORDER BY b.bucket) AS v
  FROM {tbl} s CROSS JOIN range(0, {dim}) b(bucket) LEFT JOIN {p}w w ON w.id = s.{id_col} AND w.bucket = b.bucket
  GROUP BY s.{id_col})"""


COS_SAFE = """CASE WHEN sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)) > 0
  THEN list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) ELSE 0.0 END"""


@register("ground_truth", f"""WITH {hash_dense_sql('d', 'doc_id', 'documents')},
{hash_dense_sql('b', 'item_id', 'benchmark')},
s AS (SELECT q.id AS query_id, c.id AS id, {COS_SAFE} AS score FROM bdense q CROSS JOIN ddense c)
SELECT query_id, rk AS rank, id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM s) WHERE rk <= 5""")
def ground_truth(spark, sf_dir):
    """Exact cosine top-5 documents for every benchmark text, both sides embedded by
    the hashing embedder; one kNN plan for the whole question table."""
    docs = E.hash_embed(table(spark, sf_dir, "documents"), "text", DIM, ["doc_id"], normalize=False)
    qs = E.hash_embed(table(spark, sf_dir, "benchmark"), "text", DIM, ["item_id"], normalize=False)
    return S.exact_topk(docs, qs, 5, "cosine", id_col="doc_id", qid_col="item_id", qvec_col="embedding")
