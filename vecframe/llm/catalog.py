"""The registered queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.llm import (
    best_fit,
    bpe,
    filter_audit,
    kmeans_tree,
    licenses,
    lm_scoring,
    packing,
    period_runs,
    pii,
    secrets,
    simhash,
    toxicity,
    vector_dedup,
)

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss"
    )


@query
def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.tree_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"))


ORACLE["op5_vector_groups"] = vector_dedup.groups_sql()


@query
def op6_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


@query
def op4_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted", "n_tokens", F.size("segments").alias("n_segments"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(_table(spark, sf_dir, "documents"))


ORACLE["op8_licenses"] = licenses.summary_sql()


@query
def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lm_scoring.quality_targets(_table(spark, sf_dir, "labels"), F.col("quality") == 1)
    scores = lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)
    rounded = {c: F.round(c, 6) + F.lit(0.0) for c in ("target_loss", "background_loss", "score")}  # no negative zero
    return scores.withColumns(rounded)


ORACLE["op1_cross_entropy_difference"] = lm_scoring.scores_sql("SELECT doc_id FROM labels WHERE quality = 1")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.audit_sql()


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = packing.document_ids(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    pieces = best_fit.cut_pieces(ids).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return best_fit.take_slots(pieces)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digest(_table(spark, sf_dir, "documents"))
