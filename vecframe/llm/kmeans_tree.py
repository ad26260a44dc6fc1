"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and sent to every task; every row is indexed, in the
leaf that greedy descent leads to. A query keeps the open nodes in a priority queue by the
inner product with their centroid and takes leaves in that order. How many leaves are visited
is calibrated: for a bounded set of calibration queries the true neighbours are found among
all rows, and visits are widened until the wanted share of them lies in visited leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.llm.vectors import matrix, sample, spherical_kmeans, unit, usable
from vecframe.session import cut_lineage, ship_package

K = 20
SAMPLE_ROWS = 50_000      # rows that the tree is fitted on
LEAF_ROWS = 512           # rows wanted in a leaf
MAX_LEAVES = 4_096        # bound of the tree
BRANCHES = 16
CALIBRATION_ROWS = 256    # queries that the number of visits is calibrated with
TARGET_RECALL = 0.95
SCHEMA = "query_id long, rank int, vec_id long, score double, visits int"
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024  # one side each of a scoring group


@dataclass
class Tree:
    """Nodes with unit centroids; ``children`` is empty for leaves, ``leaf`` numbers them."""

    centers: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row by greedy descent."""
        found, open_nodes = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while open_nodes:
            node, at = open_nodes.pop()
            kids = self.children[node]
            if not len(kids):
                found[at] = self.leaf[node]
                continue
            to = (rows[at] @ self.centers[kids].T).argmax(axis=1)
            open_nodes += [(int(k), at[to == i]) for i, k in enumerate(kids) if (to == i).any()]
        return found

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                yield int(self.leaf[node])
                continue
            for score, kid in zip((self.centers[kids] @ query).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (-score, kid))


def fit_tree(rows: np.ndarray, leaves: int) -> Tree:
    """A tree with about ``leaves`` leaves over unit rows, split by spherical k-means."""
    leaf_rows = max(1, math.ceil(len(rows) / max(1, leaves)))
    centers, children = [rows.mean(axis=0)], [np.empty(0, np.int64)]
    todo = [(0, np.arange(len(rows)))]
    while todo:
        node, at = todo.pop()
        k = min(BRANCHES, math.ceil(len(at) / leaf_rows))
        kids = spherical_kmeans(rows[at], k) if k > 1 else np.empty((0, 0))
        if len(kids) < 2:
            continue
        home = (rows[at] @ kids.T).argmax(axis=1)
        children[node] = np.arange(len(centers), len(centers) + len(kids))
        for i, kid in enumerate(kids):
            todo.append((len(centers), at[home == i]))
            centers.append(kid)
            children.append(np.empty(0, np.int64))
    leaf, walk, ends = np.full(len(centers), -1), [0], 0
    while walk:  # numbered so that the leaves of a subtree are neighbours
        node = walk.pop()
        walk += children[node][::-1].tolist()
        if not len(children[node]):
            leaf[node], ends = ends, ends + 1
    return Tree(np.array(centers), children, leaf)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed the same way wherever its row lies, so copies tie."""
    return (rows * query).sum(axis=1)


def block_best(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, near: np.ndarray, k: int):
    """The ``k`` best rows but the query's own: ``near`` (any summation order) chooses, with
    a margin for rounding; exact scores and then ids decide."""
    near = np.where(ids == query_id, -np.inf, near)
    if len(near) > k:
        slack = 1e-12 * rows.shape[1] * (np.abs(query).max() * np.abs(rows).max() + 1e-300)
        at = np.flatnonzero(near >= np.partition(near, -k)[-k] - slack)
    else:
        at = np.arange(len(near))
    at = at[ids[at] != query_id]
    scores = exact_scores(rows[at], query)
    best = np.lexsort((ids[at], -scores))[:k]
    return ids[at][best], scores[best]


def _one_row_per_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, at = np.unique(ids, return_index=True)
    return kept, rows[at]


def _calibration_truth(rows: DataFrame, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Per calibration query and task the best ``k`` of all rows, with their leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict] = [{} for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vec_ids, x = _one_row_per_id(part.column(0).to_numpy(), matrix(part.column(1)))
                near = queries @ x.T
                for q, own in enumerate(ids.tolist()):
                    found, scores = block_best(vec_ids, x, own, queries[q], near[q], k)
                    merged = best[q] | dict(zip(found.tolist(), scores.tolist(), strict=True))
                    best[q] = dict(sorted(merged.items(), key=lambda r: (-r[1], r[0]))[:k])
        rows_out = [(int(own), v, s) for own, b in zip(ids, best, strict=True) for v, s in b.items()]
        if rows_out:
            q, v, s = map(list, zip(*rows_out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "vec").mapInArrow(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def visits_needed(ranks: np.ndarray, target: float) -> int:
    """The fewest leaf visits with at least ``target`` of the true neighbours in them;
    ``ranks`` are the places of the neighbours' leaves in the traversal, from 0."""
    if not len(ranks):
        return 1
    return int(np.sort(ranks)[max(0, math.ceil(target * len(ranks)) - 1)]) + 1


def tree_search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score, visits)``: for each row where the Column
    ``is_query`` holds, its ``k`` nearest among the rows found, by inner product in double
    precision, ties to the smaller id, never the query's own id.

    Vectors that are null, empty, all zero or hold null or non-finite components, and rows
    with a null id take no part, as queries or as candidates. Vectors of each dimension are
    searched among themselves, with a tree and visits of their own; a job follows another
    for each dimension. Rows with equal ids are one row. A query with fewer than
    ``k`` candidates gets all of them. Further columns are ignored. An empty table gives an
    empty table."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect()  # one row a dimension
    found = [_search(rows.where(F.size("vec") == r["dim"]), r["count"], k, target_recall) for r in dims]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], SCHEMA)


def _search(rows: DataFrame, total: int, k: int, target_recall: float) -> DataFrame:
    """The search among the ``total`` vectors ``rows(vec_id, vec, asks)`` of one dimension."""
    spark = rows.sparkSession
    seen = sample(rows, "vec", SAMPLE_ROWS)
    if not len(seen):  # the vectors are all alike, and their hash is outside the sample's share
        seen = np.array([rows.first()["vec"]], np.float64)
    leaves = max(1, min(MAX_LEAVES, math.ceil(total / LEAF_ROWS)))
    tree = spark.sparkContext.broadcast(fit_tree(unit(seen), leaves))

    chosen = rows.where("asks").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(CALIBRATION_ROWS).collect()
    chosen = {r["vec_id"]: r["vec"] for r in chosen}
    if not chosen:
        return spark.createDataFrame([], SCHEMA)
    cal_ids, cal_rows = np.array(list(chosen)), np.array(list(chosen.values()), np.float64)
    truth = _calibration_truth(rows, tree.value, cal_ids, cal_rows, k).select("query_id", "vec_id")
    truth_rows = rows.join(F.broadcast(truth), "vec_id").select("query_id", "vec").collect()  # CALIBRATION_ROWS * k

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.place(unit(matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), batch.column(1), batch.column(2)], names=["vec_id", "leaf", "vec", "asks"])

    placed = cut_lineage(rows.mapInArrow(place, "vec_id long, leaf long, vec array<double>, asks boolean"))
    counted = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()  # MAX_LEAVES rows
    held = np.zeros(tree.value.leaves, np.int64)
    for r in counted:
        held[r["leaf"]] = r["n"]

    ranks, orders = [], {i: {leaf: at for at, leaf in enumerate(tree.value.order(v))} for i, v in zip(cal_ids.tolist(), unit(cal_rows), strict=True)}
    if truth_rows:
        where = tree.value.place(unit(np.array([r["vec"] for r in truth_rows], np.float64)))
        ranks = [orders[r["query_id"]][leaf] for r, leaf in zip(truth_rows, where.tolist(), strict=True)]
    visits = visits_needed(np.array(ranks, np.int64), target_recall)

    # neighbouring leaves together make a bucket of about BLOCK_ROWS; a larger leaf is one alone
    bucket, filled = np.zeros(len(held), np.int64), 0
    for i, n in enumerate(held.tolist()):
        fresh = i and filled + n > BLOCK_ROWS
        bucket[i] = bucket[i - 1] + bool(fresh) if i else 0
        filled = n if fresh else filled + n
    row_blocks = np.maximum(1, -(-np.bincount(bucket, held).astype(np.int64) // BLOCK_ROWS))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the leaves they visit, by bucket: the calibrated number of leaves,
        and more until there are enough candidates."""
        for batch in batches:
            at, to, leaves = [], [], []
            for i, q in enumerate(unit(matrix(batch.column(1)))):
                met: dict[int, list[int]] = {}
                got, rows_met = 0, 0
                for leaf in tree.value.order(q):
                    if got >= visits and rows_met > 2 * k:
                        break
                    got, rows_met = got + 1, rows_met + int(held[leaf])
                    if held[leaf]:
                        met.setdefault(int(bucket[leaf]), []).append(leaf)
                for b, own in met.items():
                    at.append(i)
                    to.append(b)
                    leaves.append(own)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(to, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), batch.column(1).take(at)],
                names=["query_id", "bucket", "leaves", "vec"],
            )

    asked = cut_lineage(
        placed.where("asks").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "vec")
        .mapInArrow(visit, "query_id long, bucket long, leaves array<long>, vec array<double>")
    )
    query_blocks = np.ones(len(row_blocks), np.int64)
    for r in asked.groupBy("bucket").count().collect():  # at most MAX_LEAVES rows
        query_blocks[r["bucket"]] = max(1, math.ceil(r["count"] / BLOCK_QUERIES))

    def listed(values: np.ndarray, key: str):
        return F.get(F.lit(values.tolist()), F.col(key).cast("int")).cast("long")  # cogroup keys need equal types

    g, h = listed(row_blocks, "bucket"), listed(query_blocks, "bucket")
    left = placed.withColumn("bucket", listed(bucket, "leaf")).select(
        "bucket", F.pmod(F.xxhash64("vec_id"), g).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (h - 1).cast("int"))).alias("j"),
        F.col("vec_id").alias("id"), "leaf", "vec")
    right = asked.select(
        "bucket", F.explode(F.sequence(F.lit(0), (g - 1).cast("int"))).alias("i"), F.pmod(F.xxhash64("query_id"), h).cast("int").alias("j"),
        F.col("query_id").alias("id"), "leaves", "vec")

    def score(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if data.num_rows and queries.num_rows:
            data, queries = data.combine_chunks(), queries.combine_chunks()
            ids, first = np.unique(data.column("id").to_numpy(), return_index=True)  # one row per id
            x, leaf = matrix(data.column("vec").chunk(0))[first], data.column("leaf").to_numpy()[first]
            q, own_ids = matrix(queries.column("vec").chunk(0)), queries.column("id").to_numpy()
            leaves = queries.column("leaves").to_pylist()
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ x.T
                for n, i in zip(near, range(at, at + len(near)), strict=True):
                    there = np.flatnonzero(np.isin(leaf, leaves[i]))
                    found, scores = block_best(ids[there], x[there], int(own_ids[i]), q[i], n[there], k)
                    out[0].append(np.full(len(found), own_ids[i]))
                    out[1].append(found)
                    out[2].append(scores)
        made = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(made[0].astype(np.int64)), "vec_id": pa.array(made[1].astype(np.int64)), "score": pa.array(made[2].astype(np.float64))})

    keys = ["bucket", "i", "j"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return (
        hits.withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", F.lit(visits).cast("int").alias("visits"))
    )
