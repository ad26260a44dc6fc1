import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import EDGE_TEXTS, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.llm import best_fit, packing
from vecframe.llm.catalog import QUERIES, vocabulary

VOCABULARY = "word_bpe_49k.json"


def plain_best_fit(lengths, capacity):
    """Room left of each sequence, by best-fit decreasing over single pieces."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return rooms


def layout(lengths, capacity):
    """{sequence: [(offset, length)]} by the plan."""
    slots = best_fit.Slots(best_fit.plan_slots(dict(Counter(lengths)), capacity))
    rank, out = Counter(), {}
    for length in lengths:
        s, o = slots.find(np.array([length]), np.array([rank[length]]))
        rank[length] += 1
        out.setdefault(int(s[0]), []).append((int(o[0]), length))
    return out


def check_gapless(sequences, capacity):
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64, 100]))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    sequences = layout(lengths, capacity)
    check_gapless(sequences, capacity)
    rooms = [capacity - sum(n for _, n in s) for s in sequences.values()]
    assert sorted(rooms) == sorted(plain_best_fit(lengths, capacity))


def test_plan_does_not_grow_with_counts():
    random.seed(3)
    counts = {n: random.randrange(1, 1000) for n in random.sample(range(1, 4097), 2000)}
    small = best_fit.plan_slots(counts)
    large = best_fit.plan_slots({n: c * 1_000_003 for n, c in counts.items()})
    assert len(large) < 3 * len(small) < 60_000
    tokens = sum(n * c * 1_000_003 for n, c in counts.items())
    opened = sum(-(-counts[r[0]] * 1_000_003 // r[3]) for r in large if r[4] == 0)
    assert opened < 1.05 * tokens / 4096 + 2000


def test_plan_rejects_bad_lengths():
    for bad in (0, 41, None):
        with pytest.raises((ValueError, TypeError)):
            best_fit.plan_slots({bad: 1}, 40)


def ids_of(text):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary(VOCABULARY))
    model.no_padding()
    model.no_truncation()
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_documents_take_slots(spark):
    frame = docs(spark).repartition(5)
    ids = packing.document_ids(frame, vocabulary(VOCABULARY))
    rows = best_fit.take_slots(best_fit.cut_pieces(ids, 512), 512).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    check_gapless(sequences, 512)
    wanted = Counter()
    for i, text in EDGE_TEXTS:
        own = ids_of(text)
        for piece, start in enumerate(range(0, len(own), 512)):
            wanted[i, piece, start, own[start : start + 512].tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == wanted
    assert len(sequences) == len(plain_best_fit([r.length for r in rows], 512))


def test_hot_length_and_extra_columns(spark):
    lengths = [7] * 3000 + [500, 1, 512, 100] * 200
    frame = spark.createDataFrame([(n, "x", -1, 0.5) for n in lengths], "length long, _at string, offset int, _task double").repartition(16)
    rows = best_fit.take_slots(frame, 512)
    assert rows.columns == ["length", "_at", "_task", "sequence_id", "offset"]
    sequences = {}
    for r in rows.collect():
        assert (r["_at"], r["_task"]) == ("x", 0.5)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    check_gapless(sequences, 512)
    assert Counter(n for s in sequences.values() for _, n in s) == Counter(lengths)
    assert len(sequences) == len(plain_best_fit(lengths, 512))


def test_empty_and_invalid(spark):
    none = docs(spark, [])
    ids = packing.document_ids(none, vocabulary(VOCABULARY))
    assert best_fit.take_slots(best_fit.cut_pieces(ids)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, ids binary")
    assert best_fit.cut_pieces(blank).collect() == []
    for bad in (None, 0, 4097):
        with pytest.raises(ValueError):
            best_fit.take_slots(spark.createDataFrame([(bad,)], "length long"))


def test_query_on_a_table(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_best_fit_packing"](spark, str(tmp_path))
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    wanted = Counter()
    for i, text in EDGE_TEXTS:
        own = ids_of(text)
        for piece, start in enumerate(range(0, len(own), 4096)):
            part = own[start : start + 4096]
            wanted[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows.collect()) == wanted
