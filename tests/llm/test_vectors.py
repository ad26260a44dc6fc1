import numpy as np
import pytest
from fixtures import groups
from pyspark.sql import functions as F

from vecframe.llm import kmeans_tree, vector_dedup
from vecframe.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, node string, leaf string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "?", "?", "?") for i, v, lab in rows], SCHEMA)


BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0]]


def test_usable(spark):
    rows = frame(spark, [(i, v, 1) for i, v in enumerate(BAD + [[1.0, 0.0, 0.0]])])
    assert [r["vec_id"] for r in rows.where(usable("embedding")).collect()] == [len(BAD)]


def clustered(rng, n, dims=16):
    """Vectors around few directions, near-copies at many distances, exact copies."""
    base = rng.normal(size=(12, dims))
    rows = [base[i % 12] + rng.normal(size=dims) * s for i, s in zip(range(n), rng.uniform(0.02, 0.5, n), strict=True)]
    rows += [rows[int(i)].copy() for i in rng.integers(0, n, n // 5)]
    return np.array(rows, np.float32)


def brute_groups(ids, x, labels):
    x = x.astype(float)
    cos = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    link = (cos >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    comp = groups(len(ids), list(zip(*np.nonzero(link), strict=True)))
    low = {}
    for i, c in zip(ids, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    return {i: (int(d), low[c], low[c] == i) for i, d, c in zip(ids, link.sum(1), comp, strict=True)}


@pytest.mark.parametrize("cell_rows", [20, 10_000])
def test_groups_against_all_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    rng = np.random.default_rng(7)
    x = clustered(rng, 240)
    ids, labels = [int(i) for i in rng.permutation(len(x))], rng.integers(0, 3, len(x))
    rows = frame(spark, [(i, [float(c) for c in v], int(lab)) for i, v, lab in zip(ids, x, labels, strict=True)]).repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.vector_groups(rows).collect()}
    assert got == brute_groups(ids, x, labels)


def test_group_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, v, 1) for i, v in enumerate(BAD)] + [(10, one, 1), (11, one, 1), (12, one, None), (13, one, 2), (14, [2.0, 4.0, 6.0], 1),
            (15, [1.0, 2.0], 1), (16, [1e-30, 2e-30, 3e-30], 1), (17, one, 2), (17, one, 2), (None, one, 1)]
    got = {}
    for r in vector_dedup.vector_groups(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in range(len(BAD)))
    assert got[10] == [(4, 10, True)] and got[11] == [(4, 10, False)] and got[14] == [(4, 10, False)] and got[16] == [(4, 10, False)]
    assert got[12] == [(0, 12, True)] and got[15] == [(0, 15, True)]
    assert got[13] == [(2, 13, True)] and got[17] == [(2, 13, False)] * 2
    assert got[None] == [(4, 10, False)]
    assert vector_dedup.vector_groups(frame(spark, [])).collect() == []


def brute_search(ids, x, asks, k):
    out = {}
    for q in np.flatnonzero(asks):
        scores = (x.astype(float) * x[q].astype(float)).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def test_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 40)
    monkeypatch.setattr(kmeans_tree, "BLOCK_ROWS", 100)
    monkeypatch.setattr(kmeans_tree, "BLOCK_QUERIES", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # both sides must be dealt alike
    rng = np.random.default_rng(8)
    x = clustered(rng, 900)
    ids = rng.permutation(len(x))
    rows = frame(spark, [(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)]).repartition(4)
    got = {}
    for r in kmeans_tree.tree_search(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_search(ids, x, ids % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    dot = {int(i): v.astype(float) for i, v in zip(ids, x, strict=True)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - float((dot[q] * dot[v]).sum())) < 1e-12 and v != q for v, s in found)


def test_search_ties_and_few_candidates(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(20, one, 1), (7, one, 1), (3, one, 1), (5, [3.0, 1.0, 0.0], 1), (3, one, 1), (None, one, 1), (40, [0.0, 0.0, 0.0], 1), (60, None, 1), (8, [1.0, 2.0], 1)]
    got = kmeans_tree.tree_search(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 5, 3.0), (20, 2, 3, 1.0), (20, 3, 7, 1.0)]
    assert kmeans_tree.tree_search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert kmeans_tree.tree_search(frame(spark, [(1, one, 1)]), F.col("vec_id") % 20 == 0).collect() == []


def test_each_dimension_is_searched(spark):
    rng = np.random.default_rng(10)
    parts = {3: rng.normal(size=(50, 3)), 5: rng.normal(size=(90, 5)), 2: rng.normal(size=(1, 2))}
    rows, want, at = [], {}, 0
    for x in parts.values():
        ids = np.arange(at, at + len(x))
        at += len(x)
        rows += [(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)]
        x = np.array([[float(c) for c in v] for v in x])
        want.update({q: v for q, v in brute_search(ids, x, ids % 20 == 0, 20).items() if v})
    got = {}
    for r in kmeans_tree.tree_search(frame(spark, rows).repartition(3), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: [v for v, _ in found] for q, found in want.items()} == got  # one leaf each: exact


def test_vectors_all_alike_are_searched(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "SAMPLE_ROWS", 1)  # whatever share their hash falls into
    for value in (1.0, 2.0, 3.0):
        rows = [(i, [value, 1.0], 1) for i in range(60)]
        got = kmeans_tree.tree_search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
        assert len(got) == 60 and {r["query_id"] for r in got} == {0, 20, 40}


def test_traversal_visits_every_leaf_once():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    tree = kmeans_tree.fit_tree(x, 60)
    assert sorted(tree.order(x[0])) == list(range(tree.leaves))
    assert tree.place(x).max() < tree.leaves
    assert kmeans_tree.visits_needed(np.array([0, 0, 1, 5]), 0.75) == 2 and kmeans_tree.visits_needed(np.array([]), 0.9) == 1


def test_groups_against_sql(spark):
    import duckdb

    rng = np.random.default_rng(12)
    x = clustered(rng, 120)
    rows = [(int(i), [float(c) for c in v], int(rng.integers(0, 3))) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(BAD)] + [(2000, rows[0][1], None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    got = sorted(map(tuple, vector_dedup.vector_groups(frame(spark, rows)).collect()))
    assert got == sorted(con.execute(vector_dedup.groups_sql()).fetchall())
