import re

import corpus_pipeline
import numpy as np
import pytest
from fixtures import docs, groups
from test_simhash import plain_fingerprint
from test_spans import TEXTS
from test_tokens import WORDS, check_pieces

from vecframe.llm import catalog, pii, toxicity

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_": ["doc_id:bigint", "n_tokens:bigint", "score:double"],
    "op2_": ["doc_id:bigint", "start:bigint", "length:bigint", "ids_crc32:bigint", "doc_tokens:bigint", "sequence_id:bigint", "offset:bigint"],
    "op3_": ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"],
    "op4_": ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"],
    "op5_": ["vec_id:bigint", "n_links:bigint", "component_id:bigint", "kept:boolean"],
    "op6_": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
    "op7_": ["doc_id:bigint", "n_email:bigint", "n_ip:bigint", "n_card:bigint", "n_phone:bigint", "base_sha256:string", "spans:string"],
    "op8_": ["doc_id:bigint", "license:string", "dice:double"],
    "op9_": ["doc_id:bigint", "fingerprint:string", "component_id:bigint"],
    "op10_": ["doc_id:bigint", "n_assign:bigint", "n_access:bigint", "n_hex:bigint", "base_sha256:string", "spans:string"],
}


@pytest.mark.parametrize("prefix", CONTRACT)
def test_columns_of_the_queries(spark, prefix):
    [name] = [n for n in catalog.QUERIES if n.startswith(prefix)]
    frame = catalog.QUERIES[name](spark, SF)
    assert set(CONTRACT[prefix]) <= {f"{c}:{t}" for c, t in frame.dtypes}
    assert frame.count() > 0


def test_entry_registers_queries_and_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(catalog.QUERIES) <= names and "pipeline" in names
    assert entry.oracle_sql()["op8_licenses"] == catalog.ORACLE["op8_licenses"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "packing"]


def test_pipeline_against_plain_stages(spark):
    """Every stage but the learned scores in plain Python; packing by its ids."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in frame.collect()}
    toxic = {r["doc_id"] for r in toxicity.toxicity_scores(frame, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    left = sorted(i for i in rows if i not in toxic)
    prints = [plain_fingerprint(rows[i]) for i in left]
    group = groups(len(left), [(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    kept = [i for n, i in enumerate(left) if group[n] == n]
    found = {r["doc_id"]: r["found"] for r in pii.find_pii(frame).collect()}
    want = {}
    for i in kept:
        text, at, out = rows[i], 0, []
        for s in found[i]:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        text = "".join(out) + text[at:]
        want[i] = WORDS.encode(text, add_special_tokens=False).ids + [1]
    assert 0 < len(kept) < len(left) < len(rows)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)
    check_pieces(pieces, want)


def test_stages_keep_columns_and_take_any_rows(spark):
    frame = docs(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, TEXTS[3]), (3, TEXTS[3])]).drop("start")
    for rows in (frame, frame.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == frame.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert bool(pieces) == bool(rows.count())
        assert all(not re.search("@one.org", r["text"] or "") for r in now.collect())
        assert np.all([p["length"] > 0 for p in pieces])
