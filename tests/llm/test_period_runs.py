import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from fixtures import EDGE_TEXTS, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.llm import period_runs
from vecframe.llm.catalog import QUERIES


def plain_runs(x):
    """(start, period, length): every maximal stretch of each period, smallest period only."""
    found, n = {}, len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, q, length) for (s, length), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert [tuple(r) for r in period_runs.runs(words, text)] == joined(texts)


def joined(texts):
    at, out = 0, []
    for t in texts:
        out += [(s + at, q, n) for s, q, n in plain_runs(t)]
        at += len(t)
    return sorted(out)


def test_runs_of_planted_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(3):
            t = []
            for _ in range(rng.randrange(1, 5)):
                block = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 12))]
                repeated = block * rng.randrange(1, 9) + block[: rng.randrange(len(block))]
                t += repeated + [rng.randrange(50) for _ in range(rng.randrange(6))]
            texts.append(t)
        words = np.array([w for t in texts for w in t], np.int64)
        text = np.repeat(np.arange(3), [len(t) for t in texts])
        assert [tuple(r) for r in period_runs.runs(words, text)] == joined(texts)


def test_long_repeats_stay_cheap():
    began = time.time()
    one = np.zeros(60_000, np.int64)
    assert period_runs.runs(one, np.zeros_like(one)).tolist() == [[0, 1, 60_000]]
    pair = np.tile(np.arange(700), 90)
    assert period_runs.runs(pair, np.zeros_like(pair)).tolist() == [[0, 700, 63_000]]
    rng = np.random.default_rng(1)
    many = np.concatenate([np.append(np.zeros(rng.integers(50, 90), np.int64), i) for i in range(1, 600)])
    assert len(period_runs.runs(many, np.zeros_like(many))) == 599
    assert time.time() - began < 60


def plain_digest(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, q, m in found for k in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    head = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in found)
    return (i, len(found), *head, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def digests(spark, rows):
    return sorted((tuple(r) for r in period_runs.run_digest(docs(spark, rows)).collect()), key=key)


def test_digests_of_edge_texts(spark):
    rows = [r for r in EDGE_TEXTS if r[0] != 5] + [(5, "the cat sat on the mat and looked at me. " * 40)]
    rng = random.Random(2)
    for i in range(100, 400):
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(rng.choice("ab漢") for _ in range(rng.randrange(80)))))
    rows += [(i, " ".join(f"w{k}" for k in range(rng.randrange(200)))) for i in range(400, 600)]
    rows += [(7001, " lead and trail "), (7001, " lead and trail "), (-3, "n " * 9), (7002, "x x x x " * 5), (7003, "a\x00b " * 7)]
    assert digests(spark, rows) == sorted((plain_digest(*r) for r in rows), key=key)


def test_texts_and_runs_of_the_operator(spark):
    frame = docs(spark, [(1, "so  we go we go we go we go on"), (2, None)])
    rows = {r.doc_id: r for r in period_runs.periodic_runs(frame).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(1, 8, 2)]
    assert tuple(rows[1].strongest) == (1, 8, 2)
    assert rows[1].collapsed == "so we go on"
    assert rows[2].runs == [] and rows[2].strongest is None and rows[2].collapsed == ""


def test_empty_table(spark):
    assert period_runs.run_digest(docs(spark, [])).collect() == []


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").select("doc_id", "text").collect()
    found = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(rows) > 100
    for r in rows:
        assert found[r.doc_id] == plain_digest(r.doc_id, r.text)
