"""Sinks (K1-K4): JSON run report, CSV summaries and their published copy, per-document
text export. Writers go through the DataFrame writer; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.functions.text import py_strip


def report_rows(runs: DataFrame) -> DataFrame:
    """K1 (row form): one JSON object per run record."""
    return runs.select(F.to_json(F.struct(*runs.columns)).alias("json"))


def report_document(runs: DataFrame, timestamp: str) -> DataFrame:
    """K1: ``{"timestamp": ..., "results": [...]}`` as one row. A run table has one row
    per (store, size), so the list is small by construction."""
    doc = runs.agg(F.collect_list(F.struct(*runs.columns)).alias("results"))
    return doc.select(F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), "results")).alias("json"))


def write_report(runs: DataFrame, path: str, timestamp: str) -> None:
    report_document(runs, timestamp).repartition(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """K2: header row, no index. A summary is small, so it is written as one file."""
    out = df.repartition(1) if single_file else df  # the summary is made in parallel, then gathered
    out.write.mode("overwrite").option("header", True).csv(path)


def publish_csv(df: DataFrame, paths: list[str]) -> None:
    """K2+K3: the same summary written to several targets (persisted once)."""
    df = df.persist()
    try:
        for p in paths:
            write_csv(df, p)
    finally:
        df.unpersist()


def export_texts(df: DataFrame, pos_col: str, text_col: str, max_docs: int = 0,
                 name_format: str = "doc_%06d.txt") -> DataFrame:
    """K4 content: ``(name, text)`` for the first ``max_docs`` rows by position (0 = all),
    stripped, blank ones skipped; the name keeps the source position."""
    d = df.select(F.col(pos_col), py_strip(text_col).alias("text"))
    if max_docs:
        d = d.filter(F.col(pos_col) < max_docs)
    d = d.filter(F.length("text") > 0)
    return d.select(F.format_string(name_format, F.col(pos_col)).alias("name"), "text")


def write_texts(named: DataFrame, out_dir: str) -> None:
    """K4 files: one folder ``name=<file name>`` per document holding its text."""
    named.repartition("name").write.mode("overwrite").partitionBy("name").text(out_dir)
