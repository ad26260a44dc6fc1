"""Registered corpus-preparation, source and text queries over ``documents``, ``pages``,
``conversations``, ``benchmark`` and ``events`` (P1-P16, S2-S12, V6-V7, K4, K11, K12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecframe.functions import embed as E
from vecframe.functions import text as X
from vecframe.functions.temporal import elapsed_ms, stamp
from vecframe.operators.ranking import dense_ids, join_null_safe, with_positions
from vecframe.plans.registry import register
from vecframe.plans.tables import TABLES, table
from vecframe.sources import corpus as C

STRIP_SQL = X.STRIP_PATTERN
DIM = 64


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '{STRIP_SQL}', '', 'g')"


_PREP = f"""prep AS (
  SELECT doc_id, {_strip_sql('text')} AS text, lang FROM documents),
kept AS (SELECT doc_id, text, lang FROM prep WHERE length(text) >= 50)"""


@register("text_strip", f"SELECT doc_id, {_strip_sql('text')} AS text FROM documents")
def text_strip(spark, sf_dir):
    """Python-style strip of every document."""
    return docs(spark, sf_dir).select("doc_id", X.py_strip("text").alias("text"))


@register("min_len_filter", f"WITH {_PREP} SELECT p.doc_id, p.text FROM prep p WHERE length(p.text) >= 50")
def min_len_filter(spark, sf_dir):
    """Documents of at least 50 characters after the strip."""
    d = docs(spark, sf_dir).select("doc_id", X.py_strip("text").alias("text"))
    return d.filter(F.length("text") >= 50)


@register("max_len_truncate", f"WITH {_PREP} SELECT doc_id, left(text, 1000) AS text FROM kept")
def max_len_truncate(spark, sf_dir):
    """Strip, length filter and cut to 1000 characters (the loader's max_chars)."""
    return C.prepare_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", 50, 1000)


@register("capped_corpus", f"WITH {_PREP} SELECT doc_id, text FROM kept ORDER BY doc_id LIMIT 200")
def capped_corpus(spark, sf_dir):
    """The first 200 surviving documents (the loader's max_docs), whole texts."""
    prepared = C.prepare_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", 50, 0)
    return C.cap_in_order(prepared, ["doc_id"], 200)


@register("dense_ids", f"WITH {_PREP} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM kept")
def dense_ids_q(spark, sf_dir):
    """P5: consecutive ids over the surviving documents, in doc_id order."""
    prepared = C.prepare_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", 50, 0)
    return dense_ids(prepared.select("doc_id"), ["doc_id"], ["doc_id"], id_col="id").select("id", "doc_id")


_EXT_SQL = """regexp_extract(regexp_replace(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '([^/]*)$', 1), '^\\.+', ''),
                      '(\\.[^.]*)$', 1)"""


@register("topic_from_path", f"""
SELECT page_id, coalesce(nullif(regexp_replace({_EXT_SQL}, '^\\.+', ''), ''), 'file') AS topic FROM pages""")
def topic_from_path(spark, sf_dir):
    """topic = extension without the dot, else 'file'."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.topic_from_ext(X.path_extension("url", strip_query=True)).alias("topic"))


@register("ext_filter", f"SELECT page_id, url FROM pages WHERE lower({_EXT_SQL}) IN ('.html', '.htm')")
def ext_filter(spark, sf_dir):
    """Pages whose URL path has an allowed extension (list normalised: trim, lower,
    blank dropped, dot added)."""
    p = table(spark, sf_dir, "pages")
    return p.filter(X.ext_allowed("url", ["HTML", " htm ", ""], strip_query=True)).select("page_id", "url")


@register("prepare_corpus", f"""WITH {_PREP}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id, text, lang AS topic FROM kept""")
def prepare_corpus(spark, sf_dir):
    """Strip -> length filter -> (no cut, no cap: 0 = unlimited) -> dense ids -> topic,
    over all documents and whole texts."""
    prepared = C.prepare_texts(docs(spark, sf_dir).select("doc_id", "text", "lang"), "text", 50, 0)
    return C.numbered(prepared, ["doc_id"]).select(
        "id", "doc_id", "text", F.col("lang").alias("topic")
    )


_CHUNKS = f"""st AS (SELECT doc_id, {_strip_sql("coalesce(text, '')")} AS t FROM documents),
win AS (
  SELECT doc_id, j, {_strip_sql('substring(t, j * 850 + 1, 1000)')} AS chunk
  FROM (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil((length(t) - 1000) / 850.0) AS BIGINT), 0) + 1)) AS j
        FROM st WHERE length(t) > 0)),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS chunk_ix, chunk
  FROM win WHERE length(chunk) > 0)"""


@register("chunk_text", f"WITH {_CHUNKS} SELECT doc_id, chunk_ix, chunk FROM chunks")
def chunk_text(spark, sf_dir):
    """Every document cut into 1000-character chunks overlapping by 150."""
    return X.chunk_text(docs(spark, sf_dir), "text", 1000, 150, keep=["doc_id"])


@register("chunk_stats", f"""WITH {_CHUNKS}
SELECT doc_id, count(*) AS n_chunks, avg(length(chunk)) AS avg_chunk_chars FROM chunks GROUP BY doc_id""")
def chunk_stats(spark, sf_dir):
    """Chunks per document and mean chunk length."""
    ch = X.chunk_text(docs(spark, sf_dir), "text", 1000, 150, keep=["doc_id"])
    return ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.length("chunk")).alias("avg_chunk_chars"))


# Filler question when a file corpus has fewer than five documents.
FILLER_QUESTION = "What is this document about?"


@register("query_texts", f"""WITH {_PREP},
firsts AS (SELECT doc_id, left(text, 200) AS query_text FROM kept ORDER BY doc_id LIMIT 5),
q AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS query_id, query_text FROM firsts)
SELECT * FROM q
UNION ALL SELECT (SELECT count(*) FROM q), '{FILLER_QUESTION}' WHERE (SELECT count(*) FROM q) < 5""")
def query_texts(spark, sf_dir):
    """P10: the query set of a file corpus: the first 200 characters of its first five
    documents, plus one filler question when there are fewer than five."""
    from vecframe.operators.rag import corpus_query_texts

    prepared = C.prepare_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", 50, 0)
    return corpus_query_texts(prepared, "doc_id", "text", n_queries=5, width=200, filler=FILLER_QUESTION)


@register("synthetic_corpus", """
SELECT doc_id AS id,
  printf('[%s] %s %s %s (doc_id=%d)', t, s1, s2, s3, doc_id) AS text, t AS topic
FROM (
  SELECT doc_id,
    ['sports','finance','medicine','databases','ai','music','movies','books','travel','security','networks','cloud']
      [('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), '0')), 1, 8))::BIGINT % 12 + 1] AS t,
    {S}[('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), '1')), 1, 8))::BIGINT % 15 + 1] AS s1,
    {S}[('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), '2')), 1, 8))::BIGINT % 15 + 1] AS s2,
    {S}[('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), '3')), 1, 8))::BIGINT % 15 + 1] AS s3
  FROM documents)
""".replace("{S}", "[" + ", ".join("'" + s + "'" for s in C.BASE_SENTENCES) + "]"))
def synthetic_corpus(spark, sf_dir):
    """One synthetic document per document id of the table (seed 42)."""
    return C.synthetic_corpus(docs(spark, sf_dir).select("doc_id"), 42, "doc_id")


@register("text_autodetect", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, {_strip_sql('text')} AS text, 'table' AS topic FROM documents""")
def text_autodetect(spark, sf_dir):
    """The text column of ``documents`` found by name, every row, whole texts."""
    return C.text_table(docs(spark, sf_dir), id_col="doc_id")


@register("nested_text_field", f"""
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, {_strip_sql('text')} AS text, 'table' AS topic
FROM conversations""")
def nested_text_field(spark, sf_dir):
    """The text field picked out of a record column (``document STRUCT<role, text>``)."""
    c = table(spark, sf_dir, "conversations")
    rec = c.select("conv_id", "turn", F.struct("role", "text").alias("document"))
    return C.text_table(rec, "document", id_col=["conv_id", "turn"])


@register("vector_scan", """
SELECT vec_id AS id, 'vec_' || CAST(vec_id AS VARCHAR) AS text, len(embedding) AS dim,
       sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
FROM embeddings""")
def vector_scan(spark, sf_dir):
    """Vector rows of the table with their text label, dimension and norm."""
    from vecframe.functions.vectors import norm

    v = C.vector_table(table(spark, sf_dir, "embeddings"), id_col="vec_id")
    return v.select("id", "text", F.size("embedding").alias("dim"), norm("embedding").alias("norm"))


@register("query_prefix", """
SELECT vec_id AS query_id, len(embedding) AS dim,
       sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
FROM embeddings ORDER BY vec_id LIMIT 100""")
def query_prefix(spark, sf_dir):
    """S7, query side: the first 100 query vectors by id (the prefix is the feature; the
    table has no ``test`` column, so the corpus column is searched for itself)."""
    from vecframe.functions.vectors import norm

    q = C.vector_queries(table(spark, sf_dir, "embeddings"), "vec_id", max_queries=100)
    return q.select("query_id", F.size("query_vec").alias("dim"), norm("query_vec").alias("norm"))


@register("largest_table", "SELECT name, rows FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES) + ") ORDER BY rows DESC, name LIMIT 1")
def largest_table(spark, sf_dir):
    """The table with the most rows."""
    return C.largest_table({t: table(spark, sf_dir, t) for t in TABLES})


@register("source_fallback", f"""
WITH b AS (SELECT item_id, {_strip_sql('text')} AS text FROM benchmark),
t AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS id, text FROM b)
SELECT id, text FROM t
UNION ALL SELECT vec_id, 'vec_' || CAST(vec_id AS VARCHAR) FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM t)""")
def source_fallback(spark, sf_dir):
    """Texts of ``benchmark``; vector rows only if no text survives."""
    texts = C.text_table(table(spark, sf_dir, "benchmark"), id_col="item_id").select("id", "text")
    vecs = C.vector_table(table(spark, sf_dir, "embeddings"), id_col="vec_id").select("id", "text")
    return C.with_fallback(texts, vecs)


_HASH = """t AS (SELECT {id} AS {id_out}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {tbl}),
f AS (SELECT {id_out}, md5(tok) AS h FROM t WHERE length(tok) > 0),
c AS (
  SELECT {id_out}, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS BIGINT) AS bucket,
         sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS cnt
  FROM f GROUP BY ALL HAVING sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) <> 0),
w AS (SELECT {id_out}, bucket, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY {id_out})) AS weight FROM c)"""


@register("hash_embed", "WITH " + _HASH.format(id="doc_id", id_out="doc_id", tbl="documents") + " SELECT * FROM w")
def hash_embed(spark, sf_dir):
    """V6: feature-hashing embedding of every document (non-zero unit weights)."""
    return E.hash_weights(docs(spark, sf_dir), "text", DIM, ["doc_id"])


@register("embed_queries", "WITH " + _HASH.format(id="item_id", id_out="query_id", tbl="benchmark") + " SELECT * FROM w")
def embed_queries(spark, sf_dir):
    """V7: the benchmark texts embedded with the same embedder."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.hash_weights(b, "text", DIM, ["query_id"])


@register("elapsed_ms", """
SELECT event_id, event_type AS db,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1000.0 AS gap_ms
FROM events""")
def elapsed_ms_q(spark, sf_dir):
    """Milliseconds since the previous request of the same store.

    The predecessor is found by position (scalable ranking) and an equi-join on
    ``(db, pos)``, so no store's whole log goes through one task.
    """
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("db"), "ts")
    pos = with_positions(ev, ["db"], ["ts"], ["event_id"], total_col=None, groups_bounded=True)  # the stores
    prev = pos.select("db", (F.col("pos") + 1).alias("pos"), F.col("ts").alias("prev_ts"))
    return join_null_safe(pos, prev, ["db", "pos"], "left").select("event_id", "db", elapsed_ms("prev_ts", "ts").alias("gap_ms"))


@register("stamp_format", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def stamp_format(spark, sf_dir):
    """Run stamps ``yyyyMMdd_HHmmss``."""
    return table(spark, sf_dir, "events").select("event_id", stamp("ts").alias("stamp"))


@register("export_docs", f"""
SELECT printf('doc_%06d.txt', doc_id) AS name, {_strip_sql('text')} AS text FROM documents
WHERE length({_strip_sql('text')}) > 0""")
def export_docs(spark, sf_dir):
    """K4 (content): one named text per non-blank document; the name keeps its position."""
    from vecframe.sources.sinks import export_texts

    return export_texts(docs(spark, sf_dir), "doc_id", "text", max_docs=0)


@register("payload_bounds", """
SELECT doc_id AS id, substring(coalesce(text, ''), 1, 1024) AS text, substring(coalesce(lang, ''), 1, 64) AS topic
FROM documents""")
def payload_bounds(spark, sf_dir):
    """Payload defaults and bounded lengths (text 1024, topic 64)."""
    from vecframe.operators.ingest import bound_payload

    return bound_payload(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("topic")))


@register("optional_topic", """
SELECT doc_id AS id, text, lang AS topic FROM documents
UNION ALL SELECT item_id, text, NULL FROM benchmark""")
def optional_topic(spark, sf_dir):
    """Rows with and without a topic column stacked; the missing topic is NULL."""
    from vecframe.operators.ingest import stack_optional

    a = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("topic"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return stack_optional([a, b])
