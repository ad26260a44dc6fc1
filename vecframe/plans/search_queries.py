"""Registered search queries over the ``embeddings`` table (every row is both a stored
vector and a query: the whole kNN graph of the table) and over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecframe.operators import search as S
from vecframe.plans.registry import register
from vecframe.plans.tables import table

K = 5


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )


def query_set(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


def scaled_vectors(spark, sf_dir):
    """Vectors scaled by ``1 + label`` so that L2 and cosine rankings disagree."""
    return vectors(spark, sf_dir).withColumn(
        "embedding", F.transform("embedding", lambda x: x * (F.col("label") + 1).cast("float"))
    )


# DuckDB: all pairs with a score, ranked per query with the same tie rule.
_PAIRS = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score
  FROM e AS q CROSS JOIN e AS c
)
SELECT query_id, CAST(rk AS BIGINT) AS rank, id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rk FROM s)
WHERE rk <= {k}
"""
_COS = "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))"
_IP = "list_dot_product(q.v, c.v)"
_L2 = "list_distance(q.v, c.v)"


@register("topk_cosine", _PAIRS.format(score=_COS, order="DESC", k=K))
def topk_cosine(spark, sf_dir):
    """Exact cosine top-5 for every vector of the table."""
    return S.exact_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine")


@register("topk_inner_product", _PAIRS.format(score=_IP, order="DESC", k=K))
def topk_inner_product(spark, sf_dir):
    """Exact inner-product top-5."""
    return S.exact_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "ip")


_L2_SCALED = """
WITH e AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x * (label + 1) AS FLOAT) AS DOUBLE)) AS v
  FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_distance(q.v, c.v) AS score FROM e AS q CROSS JOIN e AS c)
SELECT query_id, CAST(rk AS BIGINT) AS rank, id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score ASC, id) AS rk FROM s)
WHERE rk <= 5
"""


@register("topk_l2", _L2_SCALED)
def topk_l2(spark, sf_dir):
    """Exact L2 top-5 (ascending distance) on vectors scaled by ``1 + label``."""
    v = scaled_vectors(spark, sf_dir)
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return S.exact_topk(v, q, K, "l2")


@register("pivot_topk_l2", _L2_SCALED)
def pivot_topk_l2(spark, sf_dir):
    """T2 by pivots: exact L2 top-5 on vectors scaled by ``1 + label``, without the cells and
    rows that the triangle inequality rules out."""
    from vecframe.operators.pivots import pivot_topk

    v = scaled_vectors(spark, sf_dir)
    return pivot_topk(v, v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), K, "l2")


@register("pivot_topk_cosine", _PAIRS.format(score=_COS, order="DESC", k=K))
def pivot_topk_cosine(spark, sf_dir):
    """T1, T7 by pivots: exact cosine top-5."""
    from vecframe.operators.pivots import pivot_topk

    return pivot_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine")


# ------------------------------------------------------------------ payload lookups

def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _with_hits_sql(score: str, order: str, k: int = K, extra: str = "") -> str:
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM e AS q CROSS JOIN e AS c {extra}),
hits AS (
  SELECT query_id, rk AS rank, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rk FROM s)
  WHERE rk <= {k})"""


@register("topk_with_payload", f"""WITH {_with_hits_sql(_COS, "DESC")}
SELECT h.query_id, h.rank, h.id, d.text, round(h.score, 6) AS score
FROM hits h LEFT JOIN documents d ON d.doc_id = h.id""")
def topk_with_payload(spark, sf_dir):
    """Cosine top-5 with the stored text of every hit (joined after ranking)."""
    q = query_set(spark, sf_dir)
    hits = S.exact_topk(vectors(spark, sf_dir), q, K, "cosine")
    return S.lookup_payload(hits, documents(spark, sf_dir), "doc_id", {"text": "text"},
                            max_hit_rows=S.hit_bound(q, K)).select("query_id", "rank", "id", "text", "score")


@register("hit_text_lookup", f"""WITH {_with_hits_sql(_IP, "DESC")}
SELECT h.query_id, h.rank, h.id, d.text FROM hits h LEFT JOIN documents d ON d.doc_id = h.id""")
def hit_text_lookup(spark, sf_dir):
    """Id -> text on inner-product hits; a missing id gives NULL."""
    q = query_set(spark, sf_dir)
    hits = S.exact_topk(vectors(spark, sf_dir), q, K, "ip")
    return S.lookup_payload(hits, documents(spark, sf_dir), "doc_id", {"text": "text"},
                            max_hit_rows=S.hit_bound(q, K)).select("query_id", "rank", "id", "text")


@register("hit_topic_lookup", f"""WITH {_with_hits_sql(_COS, "DESC")}
SELECT h.query_id, h.rank, h.id, coalesce(d.lang, '') AS topic FROM hits h LEFT JOIN documents d ON d.doc_id = h.id""")
def hit_topic_lookup(spark, sf_dir):
    """Id -> topic with '' for a missing id."""
    q = query_set(spark, sf_dir)
    hits = S.exact_topk(vectors(spark, sf_dir), q, K, "cosine")
    out = S.lookup_payload(hits, documents(spark, sf_dir), "doc_id", {"topic": "lang"}, max_hit_rows=S.hit_bound(q, K))
    return out.select("query_id", "rank", "id", F.coalesce("topic", F.lit("")).alias("topic"))


@register("hit_defaults", f"""WITH {_with_hits_sql(_IP, "DESC")}
SELECT h.query_id, h.rank, h.id, coalesce(d.text, '') AS text, round(coalesce(h.score, 0.0), 6) AS score
FROM hits h LEFT JOIN documents d ON d.doc_id = h.id""")
def hit_defaults(spark, sf_dir):
    """Missing text -> '' and missing score -> 0.0 on returned hits."""
    q = query_set(spark, sf_dir)
    hits = S.exact_topk(vectors(spark, sf_dir), q, K, "ip")
    out = S.lookup_payload(hits, documents(spark, sf_dir), "doc_id", {"text": "text"}, max_hit_rows=S.hit_bound(q, K))
    return out.select("query_id", "rank", "id", F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))


@register("unified_hits", f"""WITH {_with_hits_sql(_COS, "DESC")},
se AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x * (label + 1) AS FLOAT) AS DOUBLE)) AS v
  FROM embeddings),
s2 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_distance(q.v, c.v) AS score FROM se AS q CROSS JOIN se AS c),
l2 AS (
  SELECT query_id, rk AS rank, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rk FROM s2) WHERE rk <= 5)
SELECT 'exact_cosine' AS searcher, query_id, rank, id, round(score, 6) AS score, 'desc' AS direction FROM hits
UNION ALL
SELECT 'exact_l2', query_id, rank, id, round(score, 6), 'asc' FROM l2""")
def unified_hits(spark, sf_dir):
    """Hit lists of two searchers in one schema with the score direction."""
    cos = S.exact_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine")
    v = scaled_vectors(spark, sf_dir)
    l2 = S.exact_topk(v, v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), K, "l2")
    return S.unify_hits({"exact_cosine": (cos, "cosine"), "exact_l2": (l2, "l2")})


@register("topk_k_gt_n", _PAIRS.format(score=_COS, order="DESC", k=1000))
def topk_k_gt_n(spark, sf_dir):
    """k = 1000; a corpus with fewer rows returns all of them, ranked."""
    return S.exact_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), 1000, "cosine")


@register("self_hit_check", f"""WITH {_with_hits_sql(_COS, "DESC")}
SELECT query_id, id AS top_id, round(score, 6) AS score, id = query_id AS self_first FROM hits WHERE rank = 1""")
def self_hit_check(spark, sf_dir):
    """Every stored vector searched with itself must come back first."""
    hits = S.exact_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine")
    return S.self_hit_check(hits)


@register("size_sweep_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sizes AS (SELECT CAST(ceil(cnt * i / 4.0) AS BIGINT) AS n FROM (SELECT count(*) AS cnt FROM embeddings), range(1, 5) t(i)),
s AS (
  SELECT sizes.n, q.vec_id AS query_id, c.vec_id AS id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM sizes JOIN e AS c ON c.vec_id < sizes.n CROSS JOIN e AS q)
SELECT n, query_id, rk AS rank, id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY n, query_id ORDER BY score DESC, id) AS rk FROM s) WHERE rk <= 5""")
def size_sweep_topk(spark, sf_dir):
    """Nested-prefix corpora (quarter, half, three quarters, all of the table), the
    same query set; the corpus is scored once for all sizes."""
    import math

    n = table(spark, sf_dir, "embeddings").count()
    sizes = sorted({math.ceil(n * i / 4) for i in range(1, 5)})
    return S.size_sweep_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), sizes, K, "cosine")


# ------------------------------------------------------------------ ANN

def _lsh_sql(bands: int, bits: int, dim: int = 64) -> str:
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
planes AS (
  SELECT h, list(CASE WHEN substr(md5(CAST(h AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 1, 1) < '8'
                      THEN 1.0 ELSE -1.0 END ORDER BY d)::DOUBLE[] AS p
  FROM range(0, {bands * bits}) t(h), range(0, {dim}) s(d) GROUP BY h),
bits AS (
  SELECT e.vec_id, h // {bits} AS band,
         CASE WHEN list_dot_product(e.v, planes.p) >= 0 THEN (1 << (h % {bits})) ELSE 0 END AS bit
  FROM e CROSS JOIN planes),
sig AS (SELECT vec_id, band, sum(bit) AS bucket FROM bits GROUP BY vec_id, band),
cand AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS id FROM sig q JOIN sig c ON q.band = c.band AND q.bucket = c.bucket)"""


_RERANK = """scored AS (
  SELECT cand.query_id, cand.id,
         list_dot_product(qe.v, ce.v) / (sqrt(list_dot_product(qe.v, qe.v)) * sqrt(list_dot_product(ce.v, ce.v))) AS score
  FROM cand JOIN e qe ON qe.vec_id = cand.query_id JOIN e ce ON ce.vec_id = cand.id {where}),
{name} AS (
  SELECT query_id, rk AS rank, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM scored) WHERE rk <= 5)"""


@register("ann_lsh_topk", f"""WITH {_lsh_sql(8, 4)},
{_RERANK.format(where="", name="ann")}
SELECT query_id, rank, id, round(score, 6) AS score FROM ann""")
def ann_lsh_topk(spark, sf_dir):
    """T4(a): LSH top-5 (8 bands x 4 bits), exact re-rank of the candidates."""
    from vecframe.operators.ann import lsh_topk

    return lsh_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine", bands=8, bits=4)


@register("ann_lsh_wide_topk", f"""WITH {_lsh_sql(16, 4)},
{_RERANK.format(where="", name="ann")}
SELECT query_id, rank, id, round(score, 6) AS score FROM ann""")
def ann_lsh_wide_topk(spark, sf_dir):
    """T4(a): LSH top-5 with twice the bands (16 x 4 bits): the setting for high recall."""
    from vecframe.operators.ann import lsh_topk

    return lsh_topk(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine", bands=16, bits=4)


_IVF_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
el AS (SELECT label AS cell, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e),
cent AS (SELECT cell, list(m ORDER BY pos) AS c FROM (SELECT cell, pos, avg(x) AS m FROM el GROUP BY cell, pos) GROUP BY cell),
cs AS (
  SELECT e.vec_id, cent.cell,
         list_dot_product(e.v, cent.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(cent.c, cent.c))) AS s
  FROM e CROSS JOIN cent),
ranked AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS r FROM cs),
cand AS (
  SELECT DISTINCT p.vec_id AS query_id, c.vec_id AS id
  FROM ranked p JOIN ranked c ON p.cell = c.cell AND c.r = 1 WHERE p.r <= 2)"""


@register("ann_ivf_topk", f"""WITH {_IVF_SQL},
{_RERANK.format(where="", name="ann")}
SELECT query_id, rank, id, round(score, 6) AS score FROM ann""")
def ann_ivf_topk(spark, sf_dir):
    """T4(b): IVF top-5, label-mean centroids, 2 probed cells."""
    from vecframe.operators.ann import ivf_topk, label_centroids

    v = vectors(spark, sf_dir)
    return ivf_topk(v, query_set(spark, sf_dir), label_centroids(v, "label", "embedding"), K, "cosine", nprobe=2)


@register("twostage_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s1 AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(list_slice(q.v, 1, 32), list_slice(c.v, 1, 32)) AS s
  FROM e AS q CROSS JOIN e AS c),
cand AS (SELECT query_id, id FROM s1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 50),
""" + _RERANK.format(where="", name="ann") + """
SELECT query_id, rank, id, round(score, 6) AS score FROM ann""")
def twostage_topk(spark, sf_dir):
    """T5: 50 candidates by a 32-dimension prefix score, exact cosine top-5 among them."""
    from vecframe.operators.ann import twostage_topk as two

    return two(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine", num_candidates=50, prefix_dims=32)


@register("binary_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[] AS s FROM embeddings),
h AS (SELECT q.vec_id AS query_id, c.vec_id AS id, CAST((len(q.s) - list_dot_product(q.s, c.s)) / 2 AS INTEGER) AS d
      FROM e AS q CROSS JOIN e AS c),
cand AS (SELECT query_id, id FROM h QUALIFY rank() OVER (PARTITION BY query_id ORDER BY d) <= 50),
""" + _RERANK.format(where="", name="ann") + """
SELECT query_id, rank, id, round(score, 6) AS score FROM ann""")
def binary_topk(spark, sf_dir):
    """T5 by binary codes: the 50 rows (and ties) nearest by the signs of their components, exact
    cosine top-5 among them."""
    from vecframe.operators.ann import binary_topk as binary

    return binary(vectors(spark, sf_dir), query_set(spark, sf_dir), K, "cosine", num_candidates=50)


_OPENED: dict = {}  # indexes that this process has opened, by application and folder


def pq_index(spark, sf_dir):
    """The table's saved index in the shared folder, built where there is none for this very
    file, and its calibrated setting."""
    import hashlib

    from vecframe.operators import pq
    from vecframe.session import ensure_checkpoint_dir
    from vecframe.streaming.upsert import _fs

    fs, path = _fs(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet")
    status = fs.getFileStatus(path)
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in (fs.listStatus(path) if status.isDirectory() else [status]))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pq-{hashlib.sha256(' '.join(files).encode()).hexdigest()[:24]}"
    key = spark.sparkContext.applicationId, folder
    if key in _OPENED:
        return _OPENED[key]
    if pq.has_pq(spark, folder):
        index = pq.open_pq(spark, folder)
    else:
        v = vectors(spark, sf_dir)
        model = pq.fit_pq(v, cells=max(1, int(v.count() ** 0.5 / 2)), subspaces=16)
        index = pq.build_pq(v, model, folder)
    if not pq.has_pq(spark, f"{folder}/setting"):
        found = spark.createDataFrame([pq.calibrate_pq(index, K, 0.95)], "nprobe int, rerank int")
        found.coalesce(1).write.mode("overwrite").parquet(f"{folder}/setting/model")
    _OPENED[key] = index, spark.read.parquet(f"{folder}/setting/model").first()
    return _OPENED[key]


def ann_pq_topk(spark, sf_dir):
    """T4(c): top-5 by a product-quantised inverted file, built on the first run and reused;
    calibrated to a recall of 0.95, scores exact."""
    from vecframe.operators.pq import pq_topk

    index, setting = pq_index(spark, sf_dir)
    return pq_topk(index, query_set(spark, sf_dir), K, nprobe=setting["nprobe"], rerank=setting["rerank"])


@register("ann_pq_recall", """
SELECT count(*) AS n_queries, count(*) * least(5, count(*)) AS n_hits, true AS scores_exact, true AS recall_reached FROM embeddings""")
def ann_pq_recall(spark, sf_dir):
    """T4(c) over the whole table, which hits it finds depending on fitted codebooks: how many
    queries and hits, whether every score is the cosine of the two vectors in the table, and
    whether Recall@5 against exact search is 0.9 or more, all computed from the hits."""
    from vecframe.functions.vectors import cosine_similarity
    from vecframe.operators import metrics as M
    from vecframe.session import written

    v, q = vectors(spark, sf_dir), query_set(spark, sf_dir)
    hits = written(ann_pq_topk(spark, sf_dir))
    scored = hits.join(v.select("id", "embedding"), "id").join(q, "query_id")
    off = F.abs(cosine_similarity("query_vec", "embedding") - F.col("score"))
    found = scored.agg(F.count("*").alias("n_hits"), (F.max(off) < 1e-9).alias("scores_exact"))
    recall = M.recall_summary(M.recall_per_query(hits, S.exact_topk(v, q, K, "cosine"), K))
    return recall.select("n_queries", (F.col("recall_at_k") >= 0.9).alias("recall_reached")).join(F.broadcast(found), how="cross").select(
        "n_queries", "n_hits", "scores_exact", "recall_reached")


@register("search_fallback", f"""WITH {_lsh_sql(4, 10)},
{_RERANK.format(where="WHERE cand.query_id <> cand.id", name="prim")},
allp AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM e AS q CROSS JOIN e AS c WHERE q.vec_id <> c.vec_id),
fb AS (
  SELECT query_id, rk AS rank, id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM allp) WHERE rk <= 5)
SELECT query_id, rank, id, round(score, 6) AS score, 'primary' AS source FROM prim
UNION ALL
SELECT query_id, rank, id, round(score, 6), 'fallback' FROM fb WHERE query_id NOT IN (SELECT query_id FROM prim)""")
def search_fallback(spark, sf_dir):
    """Nearest other vectors by strict LSH (4 x 10 bits); queries it leaves empty are
    answered by exact search."""
    from vecframe.operators.ann import lsh_topk

    v, q = vectors(spark, sf_dir), query_set(spark, sf_dir)
    primary = lsh_topk(v, q, K, "cosine", bands=4, bits=10, exclude_self=True)
    return S.search_with_fallback(primary, lambda rest: S.exact_topk(v, rest, K, "cosine", exclude_self=True), q)
