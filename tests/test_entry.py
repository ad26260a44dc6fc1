import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_contract_keys():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 80
    assert set(sql) <= set(qs)
    from vecframe.plans.catalog import ORACLE, QUERIES

    assert set(QUERIES) <= set(qs)
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "text", "score"]
    assert df.count() > 0


def test_queries_run_at_smoke_scale(spark):
    # every registered query builds and runs on the smallest tables
    qs = E.queries()
    for name in ["topk_cosine", "chunk_text", "latency_summary", "heatmap_matrix", "rag_prompts", "upsert_last_wins"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_runs_from_another_directory(tmp_path):
    """Executors import vecframe from the shipped package, not from the caller's folder."""
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry', {os.path.join(here, '__spark_entry__.py')!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', m.entry(s).count())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "ROWS 2500" in out.stdout, out.stderr[-2000:]
