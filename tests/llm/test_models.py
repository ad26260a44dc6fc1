import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import EDGE_TEXTS, EXTRA, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecframe.llm import lm_scoring, toxicity

SF = "/root/testdata/sf0.1"


# --- language-model scoring ---------------------------------------------------------------


def plain_scores(rows, targets):
    """Both bigram models in plain Python."""
    texts = [(i, (t or "").encode().lower().split(), i in targets) for i, t in rows]
    words, in_target = Counter(), Counter()
    for _, w, t in texts:
        words.update(w)
        in_target.update(w if t else [])
    tokens = sum(words.values())
    vocab = {w for w, c in words.items() if c >= lm_scoring.LEAST_COUNT}
    out = {}
    pairs, uni, context = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for _, w, t in texts:
        for m in (0, 1) if t else (0,):
            uni[m].update(x if x in vocab else None for x in w)
            context[m].update([*w, "<start>"])
            pairs[m].update(zip(["<start>", *w], w, strict=False))
    kept = {p for p, c in pairs[0].items() if c >= lm_scoring.LEAST_COUNT}
    size = len(vocab) + 1
    taken = [{}, {}]
    for p in kept:
        for m in (0, 1):
            taken[m][p] = max(pairs[m][p] - lm_scoring.DISCOUNT, 0) / max(context[m][p[0]], 1e-9)
    share = lm_scoring.BIGRAM_WEIGHT

    def chance(m, a, b):
        single = (uni[m][b if b in vocab else None] + lm_scoring.UNSEEN) / (sum(uni[m].values()) + lm_scoring.UNSEEN * size)
        return share * taken[m].get((a, b), 0.0) + (1 - share) * single

    for a in [*vocab, None, "<start>"]:  # no model gives out more than there is
        assert all(1 - share - 1e-6 <= sum(chance(m, a, b) for b in [*vocab, None]) <= 1 + 1e-6 for m in (0, 1))
    for n, (i, w, _) in enumerate(texts):
        got = [sum(-math.log(chance(m, a, b)) for a, b in zip(["<start>", *w], w, strict=False)) / max(1, len(w)) for m in (1, 0)]
        out[n] = (i, len(w), *got, got[0] - got[1])
    return sorted(out.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_scores_against_plain_python(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(100 + i, " ".join(rng.choice(words[: 10 + 5 * (i % 10)], rng.integers(1, 60)))) for i in range(120)]
    rows += [r for r in EDGE_TEXTS if r[0] != 5]
    targets = {i for i, _ in rows if i and i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in targets] + [(None,), (999_999,), (102,)], "doc_id long")
    targets.add(102)
    got = sorted((tuple(r) for r in lm_scoring.cross_entropy_difference(docs(spark, rows).repartition(3), ids, block_bytes=500).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = plain_scores(rows, targets)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


def test_scoring_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = lm_scoring.cross_entropy_difference(docs(spark), none).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(math.isfinite(r["score"]) for r in rows)
    assert all(r["score"] == r["n_tokens"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert lm_scoring.cross_entropy_difference(docs(spark).limit(0), none).collect() == []


def test_every_target_is_counted(spark):
    ids = spark.range(500_000).select(F.col("id").alias("doc_id"))
    frame = ids.select("doc_id", F.lit("a b").alias("text"))
    marked = lm_scoring.mark_target(frame, ids.union(ids).repartition(4))
    assert marked.count() == marked.where("target").count() == 500_000
    assert pair_counts(lm_scoring.number_texts(marked)) == {("a", "b"): (500_000, 500_000), (None, "a"): (500_000, 500_000)}


def pair_counts(blocks, words="abcdefgh rare word the cat sat on mat"):
    """Kept pairs with their counts; None is the start."""
    known = {None: lm_scoring.START, **{w: lm_scoring.word_hash(w) for w in [*words.split(), *words]}}
    names = {lm_scoring.pair_key(np.array([x]), np.array([y]))[0]: (a, b) for a, x in known.items() for b, y in known.items()}
    rows = lm_scoring.summed(lm_scoring.pair_rows(blocks)).select("key", "background", "target").distinct().collect()
    return {names[r["key"]]: (r["background"], r["target"]) for r in rows}


def test_rare_words_stay_known_however_large_the_corpus(spark):
    """What is seen twice is kept among 600,000 tokens as among few."""
    common = [(i, "the cat sat on the mat") for i in range(100_000)]
    rows = spark.createDataFrame([*common, (100_000, "rare word"), (100_001, "rare word")], "doc_id long, text string").repartition(7)
    blocks = lm_scoring.number_texts(lm_scoring.mark_target(rows, spark.createDataFrame([(100_000,)], "doc_id long")), 50_000)
    assert blocks.count() > 20 and max(len(r["doc_ids"]) for r in blocks.select("doc_ids").collect()) < 3_000
    got = pair_counts(blocks)
    assert got["rare", "word"] == got[None, "rare"] == (2, 1) and got["the", "cat"] == (100_000, 0)
    assert lm_scoring.totals_of(lm_scoring.word_rows(blocks)).size == 8


def test_hot_ids(spark):
    """A null id, and one id on many different texts, are scored row by row."""
    rows = [(None if i % 2 else 7, f"w{i % 13} w{i % 5} w{i % 3}") for i in range(600)]
    by = lambda r: (r[0] is None, *[round(x, 6) for x in r[1:]])
    ids = spark.createDataFrame([(7,)], "doc_id long")
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(docs(spark, rows), ids, block_bytes=2_000).collect()), key=by)
    want = sorted(plain_scores(rows, {7}), key=by)
    assert len(got) == 600 and np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-9)


def files_of(spark):
    """Sizes of the session's shuffle and checkpoint files."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [*[d.getPath() for d in local], spark.conf.get("spark.checkpoint.dir").removeprefix("file:")]
    found = [os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names]
    return {f: os.path.getsize(f) for f in found if os.path.exists(f)}


def test_scoring_takes_less_disk_than_its_texts(spark):
    """Texts aren't moved, blocks are exchanged once, and keys and sums travel packed."""
    rng = np.random.default_rng(4)
    words = np.array([f"word{i:05d}" for i in range(30_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.4, 200), len(words)) - 1]) for _ in range(5_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = frame.where("doc_id % 3 = 0").select("doc_id")
    before = files_of(spark)
    lm_scoring.cross_entropy_difference(frame, ids, block_bytes=1_500_000).write.format("noop").mode("overwrite").save()
    made = sum(size for f, size in files_of(spark).items() if f not in before)
    assert made < 0.7 * sum(map(len, texts)), made / sum(map(len, texts))


def test_packed_numbers_and_ranges_of_keys(spark):
    for kind in (np.int32, np.int64, np.uint64):
        values = np.array([0, 1, np.iinfo(kind).max, 7, np.iinfo(kind).min], kind)
        for some in (values, values[:1], values[:0]):
            assert np.array_equal(lm_scoring.unpack(lm_scoring.pack(some), kind), some)
    rows = spark.createDataFrame([(i, f"a w{i % 7} b w{i % 5}") for i in range(50)], "doc_id long, text string").repartition(4)
    blocks = lm_scoring.number_texts(rows, 60)
    marked = lm_scoring.mark_blocks(blocks, spark.createDataFrame([(i,) for i in range(0, 50, 2)] * 2 + [(None,)], "doc_id long"))
    one, many = ({tuple(r) for r in lm_scoring.summed(lm_scoring.pair_rows(marked, n)).collect()} for n in (1, 40))
    assert one == many and {(b, t) for _, b, t in one} >= {(50, 25)}
    assert lm_scoring.word_rows(marked, 40).count() == 40 * blocks.count()


def test_held_out_quality(spark):
    """Models of labels outside one fold rank that fold's junk above its good texts."""
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where(~toxicity.in_holdout("doc_id"))
    good = train.where("quality = 1").select("doc_id")
    rows = lm_scoring.cross_entropy_difference(documents, good).join(labels.where(toxicity.in_holdout("doc_id")), "doc_id").toPandas()
    assert auc(rows.score[rows.quality == 0], rows.score[rows.quality == 1]) > 0.95


def auc(high, low):
    both = np.concatenate([high, low])
    ranks = np.empty(len(both))
    ranks[np.argsort(both, kind="stable")] = np.arange(1, len(both) + 1)
    return (ranks[: len(high)].sum() - len(high) * (len(high) + 1) / 2) / (len(high) * len(low))


# --- toxicity -----------------------------------------------------------------------------


def plain_segments(values):
    """Maximal segments by their definition: the best segment, then both sides of it."""
    best = None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (i, j, total)
    if best is None:
        return []
    left = plain_segments(values[: best[0]])
    right = [(a + best[1] + 1, b + best[1] + 1, s) for a, b, s in plain_segments(values[best[1] + 1 :])]
    return [*left, best, *right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.3, 2.17, -0.71, -1.93, 0.377]), max_size=30))
def test_segments_are_the_maximal_ones(scores):
    drift = 0.1237
    places = [i for i, s in enumerate(scores) if s]
    got = toxicity.maximal_segments(places, [scores[i] for i in places], drift)
    want = plain_segments([s - drift for s in scores])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9


def test_extreme_values_are_recovered():
    rng = np.random.default_rng(2)
    n, decay, scale = 400.0, 1.4, 0.002
    x = np.maximum(0, (np.log(scale * n) + rng.gumbel(size=40_000)) / decay)
    got = toxicity.extreme_value_fit([(n, float(v), 1) for v in x])
    assert abs(got[0] - decay) < 0.1 and abs(got[1] - scale) < 0.0003
    assert toxicity.extreme_value_fit([]) == (1.0, 0.5)
    assert toxicity.logistic_fit([]) == (0.0, 0.0)


def small_toxic(spark):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 60))
        toxic = int(i % 6 == 0)
        if toxic:
            for at in rng.choice(60, 4, replace=False):
                text[at] = str(rng.choice(["vilest", "scummy", "idiotic"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_a_planted_corpus(spark):
    rows, labels = small_toxic(spark)
    frame = docs(spark, rows + [(1000 + (i or 0), t) for i, t in EDGE_TEXTS] + [(None, "vilest")])
    known = spark.createDataFrame([(*r, "?") for r in labels] + [(None, 1, 1, "?"), (1001, 1, None, "?")], "doc_id long, quality int, toxic int, score string")
    got = toxicity.toxicity_scores(frame, known).collect()
    assert len(got) == len(rows) + len(EDGE_TEXTS) + 1
    toxic = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in toxic:
            assert r["predicted"] == toxic[r["doc_id"]]
            assert bool(r["segments"]) == bool(toxic[r["doc_id"]])
            text = dict(rows)[r["doc_id"]]
            for s in r["segments"]:
                assert any(w in text[s["start"] : s["end"]] for w in ("vilest", "scummy", "idiotic")) and s["evalue"] <= toxicity.SIGNIFICANT
    left = toxicity.drop_toxic(frame, known)
    assert left.columns == frame.columns
    kept = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert {i for i, t in toxic.items() if not t} <= kept and not {i for i, t in toxic.items() if t} & kept


def test_toxic_rows_go_by_their_own_text(spark):
    rows, labels = small_toxic(spark)
    toxic, clean = rows[0][1], rows[1][1]
    extra = [(5000, toxic), (5000, clean), (None, toxic), (None, clean)]
    left = toxicity.drop_toxic(docs(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] in (5000, None)]
    assert sorted(kept, key=repr) == [(5000, clean), (None, clean)]


def test_held_out_labels_are_never_learned(spark):
    rows, labels = small_toxic(spark)
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs(spark, rows), spark.createDataFrame(x, schema)).collect()}
    assert score(labels) == pytest.approx(score(turned), abs=1e-12)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs(spark), none).collect()
    assert len(rows) == len(EDGE_TEXTS) and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(1, 0), (7, 0)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.toxicity_scores(docs(spark), some).collect())
    assert toxicity.toxicity_scores(docs(spark).limit(0), some).collect() == []


def test_toxicity_on_held_out_labels(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity_scores(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.score[rows.toxic == 1], rows.score[rows.toxic == 0]) > 0.93
    assert (rows.predicted == rows.toxic).mean() > 0.97
    assert ((rows.predicted == 1) & (rows.toxic == 0)).mean() < 0.01
    assert len(EXTRA)


def test_scores_against_sql(spark):
    import duckdb

    rng = np.random.default_rng(4)
    words = [f"Word{i}" for i in range(80)]
    rows = [(100 + i, " \n".join(rng.choice(words[: 10 + 7 * (i % 10)], rng.integers(1, 50)))) for i in range(150)]
    rows += [r for r in EDGE_TEXTS if r[0] not in (None, 9)]
    targets = [(i,) for i, _ in rows if i % 3 == 0]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    con.execute("CREATE TABLE good (doc_id BIGINT)")
    con.executemany("INSERT INTO good VALUES (?)", [list(r) for r in targets])
    want = sorted(con.execute(lm_scoring.scores_sql("SELECT doc_id FROM good")).fetchall())
    got = sorted(map(tuple, lm_scoring.cross_entropy_difference(docs(spark, rows), spark.createDataFrame(targets, "doc_id long")).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=2e-6)
