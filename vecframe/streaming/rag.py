"""ST2: a stream of questions answered against a static corpus (Structured Streaming).

Ranking windows are not allowed on an unbounded frame, so each micro-batch is answered
inside ``foreachBatch`` with the batch operators: intake (G1), hashing embedder (V7),
exact top-k against the precomputed corpus vectors (T1), topic/text lookup (T9) and
prompt assembly (G3). The stop turn of every conversation is state: it is kept in
versioned Parquet folders next to the output, so an ``exit`` seen in one batch also
silences later turns of that conversation that arrive in later batches. Outputs are
written per batch id (overwrite), so a replayed batch is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.functions.embed import hash_embed
from vecframe.functions.text import py_strip
from vecframe.operators import rag as G
from vecframe.operators.search import exact_topk, lookup_payload
from vecframe.session import cut_lineage, ship_package
from vecframe.sources.corpus import numbered
from vecframe.streaming.upsert import drop_old_versions, read_current, version_path

TURN_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
STOP_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("stop", T.LongType())])


def write_prompts(questions: DataFrame, corpus_vectors: DataFrame, corpus_payload: DataFrame, path: str, k: int, dim: int) -> None:
    """Answer ``questions(conv_id, turn, question)`` and write their prompts; nothing where
    there are none."""
    q = numbered(questions, ["conv_id", "turn"], id_col="query_id").persist()
    try:
        if q.isEmpty():
            return
        qv = hash_embed(q, "question", dim, ["query_id"], normalize=False)
        hits = exact_topk(corpus_vectors, qv, k, "cosine", qvec_col="embedding")
        ctx = lookup_payload(hits, corpus_payload, "id", {"topic": "topic", "text": "text"}, max_hit_rows=q.count() * k)
        ctx = ctx.join(q.select("query_id", "conv_id", "turn"), "query_id")
        prompts = G.build_prompts(q.select("conv_id", "turn", "question"), ctx, ["conv_id", "turn"])
        prompts.write.mode("overwrite").parquet(path)
    finally:
        q.unpersist()


def start_stream_rag(
    spark: SparkSession,
    source_dir: str,
    corpus_vectors: DataFrame,
    corpus_payload: DataFrame,
    out_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    k: int = 5,
    dim: int = 64,
    available_now: bool = True,
):
    """Start answering question files in ``source_dir``.

    ``corpus_vectors``: ``(id, embedding)`` made with :func:`hash_embed` (static, scanned
    per batch, never collected); ``corpus_payload``: ``(id, topic, text)``. Prompts are
    written to ``out_dir/batch=<id>``."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        turns = batch.filter(F.col("role") == "user").select("conv_id", "turn", py_strip("text").alias("question"))
        old = read_current(spark, state_dir, STOP_SCHEMA, before=batch_id)
        new = turns.filter(F.lower("question").isin(*G.STOP_WORDS)).groupBy("conv_id").agg(F.min("turn").alias("stop"))
        stops = old.unionByName(new).groupBy("conv_id").agg(F.min("stop").alias("stop"))
        stops.write.mode("overwrite").parquet(version_path(state_dir, batch_id))
        drop_old_versions(spark, state_dir)
        stops = spark.read.parquet(version_path(state_dir, batch_id))
        q = turns.filter(F.length("question") > 0).join(stops, "conv_id", "left")
        q = q.filter(F.col("stop").isNull() | (F.col("turn") < F.col("stop"))).drop("stop")
        write_prompts(q, corpus_vectors, corpus_payload, f"{out_dir.rstrip('/')}/batch={batch_id:012d}", k, dim)

    stream = spark.readStream.schema(TURN_SCHEMA).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# ------------------------------------------------------------------ stop turns as keyed state

OPEN_QUESTIONS = "conv_id long, turn long, question string, stop long"


def open_questions(turns: DataFrame, idle_ms: int) -> DataFrame:
    """The stream's questions with Spark's state store holding each stopped conversation's stop
    turn: rows ``(conv_id, turn, question)`` of turns before the stop turn known so far, and one
    row ``(conv_id, stop)`` for every stopped conversation with turns in the batch (within a batch
    a stop may follow later turns, so :func:`before_stop` compares again).

    Only stopped conversations have state, one number each; a batch writes the numbers it
    changes. A conversation's turns pass in pieces and none is held. ``idle_ms`` after its last
    turn a stopped conversation is forgotten, and a later turn starts it anew."""
    import pandas as pd

    def update(key, pieces, state):
        if state.hasTimedOut:
            state.remove()
            return
        stop = state.get[0] if state.exists else None
        for piece in pieces:
            ends = piece.loc[piece["question"].str.lower().isin(G.STOP_WORDS), "turn"]
            if len(ends):
                stop = int(ends.min()) if stop is None else min(stop, int(ends.min()))
            asked = piece[piece["question"].str.len() > 0]
            if stop is not None:
                asked = asked[asked["turn"] < stop]
            yield asked[["conv_id", "turn", "question"]].assign(stop=pd.Series([None] * len(asked), dtype="Int64", index=asked.index))
        if stop is not None:
            state.update((stop,))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"conv_id": [key[0]], "turn": pd.array([None], "Int64"), "question": [None], "stop": pd.array([stop], "Int64")})

    users = turns.filter((F.col("role") == "user") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    rows = users.select("conv_id", "turn", py_strip("text").alias("question"))
    return rows.groupBy("conv_id").applyInPandasWithState(update, OPEN_QUESTIONS, "stop long", "append", "ProcessingTimeTimeout")


def before_stop(batch: DataFrame) -> DataFrame:
    """Questions of one batch of :func:`open_questions` before their conversation's stop turn."""
    stops = batch.where("question is null").select("conv_id", F.col("stop").alias("_stop"))
    asked = batch.where("question is not null").drop("stop").join(stops, "conv_id", "left")
    return asked.where(F.col("_stop").isNull() | (F.col("turn") < F.col("_stop"))).drop("_stop")


def start_keyed_rag(
    spark: SparkSession, source_dir: str, corpus_vectors: DataFrame, corpus_payload: DataFrame, out_dir: str, checkpoint_dir: str,
    k: int = 5, dim: int = 64, idle_ms: int = 7 * 24 * 3600 * 1000, available_now: bool = True,
):
    """ST2 with keyed state: as :func:`start_stream_rag`, but the stop turns are kept in the
    stream's own state store (:func:`open_questions`), not in a table rewritten by every batch."""
    ship_package(spark)
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch)  # the stateful operator runs once, whatever reads its rows
        write_prompts(before_stop(rows), corpus_vectors, corpus_payload, f"{out_dir.rstrip('/')}/batch={batch_id:012d}", k, dim)

    stream = open_questions(spark.readStream.schema(TURN_SCHEMA).parquet(source_dir), idle_ms)
    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    before = spark.conf.get(no_data)
    spark.conf.set(no_data, "false")  # else a state with timeouts asks for one empty batch after the other
    try:
        return writer.start()  # takes the setting over into the stream's own session
    finally:
        spark.conf.set(no_data, before)
