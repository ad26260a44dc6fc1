import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import EDGE_TEXTS, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecframe.llm import bpe, packing
from vecframe.llm.catalog import vocabulary

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001/documents.parquet"
ALPHABET = st.text(st.one_of(st.sampled_from(list("abcXYZ '.,!0123\n\t<|>ÉéßİΣς漢🎉́  ")), st.characters(codec="utf-8")), max_size=60)


def model(name):
    return tokenizers.Tokenizer.from_file(vocabulary(name))


BYTES, WORDS = model("byte_bpe_50k.json"), model("word_bpe_49k.json")
SPECIAL = ["a<|endoftext|>b", "<|endoftext|><|endoftext|> <|startoftext|>", "<|endoftext"]


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_bpe_is_the_librarys(text):
    coder = bpe.load(vocabulary("byte_bpe_50k.json"))
    ids = BYTES.encode(text, add_special_tokens=False).ids
    [got] = coder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert coder.decode(got) == BYTES.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_word_ids_are_the_librarys(text):
    [got] = packing.word_ids(vocabulary("word_bpe_49k.json")).encode(pa.array([text], pa.string())).to_pylist()
    assert np.frombuffer(got, "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_small_arrays_and_caches_change_nothing(monkeypatch):
    texts = [t or "" for _, t in EDGE_TEXTS] + SPECIAL
    want = bpe.Bpe(vocabulary("byte_bpe_50k.json")).encode(texts)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 3)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    small = bpe.Bpe(vocabulary("byte_bpe_50k.json"))
    assert [small.encode([t])[0] for t in texts] == want
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    own = packing.WordIds(vocabulary("word_bpe_49k.json"))
    for t in texts:
        assert np.frombuffer(own.encode(pa.array([t])).to_pylist()[0], "<u4").tolist() == WORDS.encode(t, add_special_tokens=False).ids


def test_digests(spark):
    frame = docs(spark, EDGE_TEXTS + list(enumerate(SPECIAL, 100)))
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(frame, vocabulary("byte_bpe_50k.json")).collect())
    want = []
    for i, t in EDGE_TEXTS + list(enumerate(SPECIAL, 100)):
        ids = BYTES.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest_documents(frame.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def check_pieces(pieces, ids_of, limit=2048):
    """Every id in one piece, sequences gapless, lengths a power of two or full."""
    documents, sequences = {}, {}
    for p in pieces:
        documents.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for key, ids in ids_of.items():
        at = 0
        for p in sorted(documents[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == limit or at & (at - 1) == 0 and at <= limit


def test_packing_of_documents(spark):
    frame = spark.read.parquet(SF).repartition(3)
    pieces = packing.pack(packing.document_ids(frame, vocabulary("word_bpe_49k.json"))).withColumn("ids_crc32", F.crc32("ids"))
    ids = {r["doc_id"]: WORDS.encode(r["text"], add_special_tokens=False).ids + [1] for r in frame.collect()}
    check_pieces(pieces.collect(), ids)


def test_packing_of_edge_rows(spark):
    rows = [(i, t) for i, t in EDGE_TEXTS if i != 9 and i is not None] + list(enumerate(SPECIAL, 100))
    frame = docs(spark, rows)
    encoded = packing.document_ids(frame, vocabulary("word_bpe_49k.json"))
    pieces = packing.pack(encoded).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(pieces, {i: WORDS.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows})
    assert packing.pack(packing.document_ids(frame.limit(0), vocabulary("word_bpe_49k.json"))).collect() == []
    twice = packing.pack(packing.document_ids(docs(spark, [(None, "a b"), (9, "c"), (9, "c")]), vocabulary("word_bpe_49k.json"))).collect()
    assert sum(p["length"] for p in twice if p["doc_id"] is None) == 3 and sum(p["length"] for p in twice if p["doc_id"] == 9) == 4


@pytest.mark.parametrize("limits", [(64, 4, 40), (64, 64, 64), (16, 1, 3)])
def test_all_three_limits_hold(spark, limits):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(400):
        n = int(rng.integers(0, 150))
        loss = None if i % 3 else bytes((rng.random(n) < 0.5).astype(np.uint8))
        want[i] = (list(range(n)), loss)
        rows.append((i, np.arange(n, dtype="<u4").tobytes(), loss))
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, ids binary, loss binary").repartition(2), limits).collect()
    per_doc, per_sequence = {}, {}
    for p in pieces:
        per_doc.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
        loss = want[p["doc_id"]][1]
        bears = p["length"] if loss is None else sum(loss[p["start"] : p["start"] + p["length"]])
        assert p["n_loss"] == bears
        s = per_sequence.setdefault(p["sequence_id"], [0, 0, 0])
        for k, v in enumerate((p["length"], 1, bears)):
            s[k] += v
    assert all(a <= b for s in per_sequence.values() for a, b in zip(s, limits, strict=True))
    for i, (ids, _) in want.items():
        assert sum((part for _, part in sorted(per_doc.get(i, []))), []) == ids


def test_little_padding(spark):
    pieces = packing.pack(packing.document_ids(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), vocabulary("word_bpe_49k.json")))
    sizes = [r["n"] for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding == 0 and sum(n == 2048 for n in sizes) >= len(sizes) - 11
