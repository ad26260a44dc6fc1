"""Exact k-nearest-neighbour join with pivots (T1, T7 by pruning).

Every row belongs to its nearest pivot (a Voronoi cell). One pass over the corpus gives, per cell,
its rows, the least and greatest distance to the pivot and the ``k`` smallest ones. From these
and a query's distances to the pivots follows, by the triangle inequality, a distance within which
its ``k`` nearest rows must lie; cells, and then rows, that cannot come that near are not scored.
What is left is scored exactly, so the answer is that of :func:`search.exact_topk`.

Cosine is searched as distance between vectors of length one. A zero vector has cosine zero with
every vector, so zero rows and zero queries get a direction of their own, at right angles to all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.operators.pq import lloyd, nearest
from vecframe.operators.search import AllPairs, arrow_matrix, broadcast_topk, no_hits, query_blocks
from vecframe.session import BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES, conf_int, ship_package, spread

MAX_PIVOTS = 1024     # and at most the square root of the rows
SAMPLE_ROWS = 20_000  # rows that pivots are fitted on, chosen by a hash of the vector
SLACK = 1e-7          # by which bounds are widened, relative to the distances they come from
TILE = 1024           # queries whose bounds are found at once


@dataclass(frozen=True)
class Cells:
    """Pivots and what is known of their cells: rows, least and greatest distance, and the
    smallest distances (infinite where there are fewer)."""

    metric: str
    pivots: np.ndarray  # (c, d), of prepared vectors
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    near: np.ndarray    # (c, k)


def prepare(X: np.ndarray, metric: str, query: bool = False) -> np.ndarray:
    """Vectors among which distance ranks like the metric."""
    if metric != "cosine":
        return X
    length = np.sqrt((X * X).sum(axis=1))
    out = np.zeros((len(X), X.shape[1] + 2))
    out[:, : X.shape[1]] = X / np.where(length > 0, length, 1.0)[:, None]
    out[length == 0, X.shape[1] + query] = 1.0
    return out


def fit_cells(corpus: DataFrame, k: int, metric: str, id_col: str = "id", vec_col: str = "embedding", pivots: int | None = None) -> Cells | None:
    """Cells of all rows with finite vectors; none if there are no such rows."""
    spark = corpus.sparkSession
    ship_package(spark)
    rows = corpus.select(F.col(vec_col).alias("v"))
    n = rows.count()
    if not n:
        return None
    share = min(1.0, SAMPLE_ROWS / n)
    some = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    X = arrow_matrix(some.limit(2 * SAMPLE_ROWS).toArrow()["v"])
    X = X[np.isfinite(X).all(axis=1)]
    if not len(X):
        return None
    X = prepare(X[np.lexsort(X.T[::-1])], metric)
    centres = lloyd(X, max(1, min(pivots or MAX_PIVOTS, int(n**0.5))), 4)
    shared = spark.sparkContext.broadcast(centres)
    dim = centres.shape[1] - (2 if metric == "cosine" else 0)

    def measure(batches):
        import pyarrow as pa

        P = shared.value
        count, near = np.zeros(len(P), np.int64), np.full((len(P), k), np.inf)
        most = np.zeros(len(P))
        for batch in batches:
            X = arrow_matrix(batch.column(0), dim)
            home, gap = cell_of(prepare(X[np.isfinite(X).all(axis=1)], metric), P)
            count += np.bincount(home, minlength=len(P))
            np.maximum.at(most, home, gap)
            order = np.lexsort((gap, home))
            home, gap = home[order], gap[order]
            place = np.arange(len(home)) - np.searchsorted(home, home)
            first = place < k
            mine = np.full((len(P), k), np.inf)
            mine[home[first], place[first]] = gap[first]
            near = np.sort(np.concatenate([near, mine], axis=1), axis=1)[:, :k]
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(most[at]), pa.array(near[at].tolist(), pa.list_(pa.float64()))],
            names=["cell", "n", "most", "near"])

    measured = spread(rows).mapInArrow(measure, "cell int, n long, most double, near array<double>")
    found = measured.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"),
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"),  # k numbers a task
    ).orderBy("cell").toArrow()  # one row a pivot
    if not found.num_rows:
        return None
    at = found["cell"].to_numpy()
    near = np.array(found["near"].to_pylist(), np.float64)
    return Cells(metric, centres[at], found["n"].to_numpy(), near[:, 0], found["most"].to_numpy(), near)


def cell_of(X: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance to its pivot, by differences, whose error does not grow with the norms."""
    home, _ = nearest(X, pivots)
    d = X - pivots[home]
    return home, np.sqrt(np.einsum("ij,ij->i", d, d))


@dataclass(frozen=True)
class Reach:
    """What some queries have to look at: their distances to the pivots, the distance that holds
    their k nearest rows, and the cells that can hold one (queries by cells)."""

    to_pivot: np.ndarray
    within: np.ndarray
    cells: np.ndarray
    slack: float


def reach(cells: Cells, Q: np.ndarray, k: int) -> Reach:
    """Bounds for prepared queries, at most ``TILE`` of them."""
    P = cells.pivots
    scale = float(np.abs(P).max(initial=0.0) + np.abs(Q).max(initial=0.0)) * P.shape[1] ** 0.5
    # products of large norms are off by up to the slack's root
    slack = SLACK * max(scale, 1e-300) + 2 * np.sqrt(np.finfo(float).eps) * scale
    d = np.sqrt(np.maximum((Q ** 2).sum(axis=1)[:, None] - 2.0 * Q @ P.T + (P * P).sum(axis=1)[None, :], 0.0))
    # the k-th smallest way over a pivot, whose own rows come in order of their distance
    ways = d + cells.near[None, :, 0]
    n = min(k, len(P))
    nearest = np.argpartition(ways, n - 1, axis=1)[:, :n]  # the k smallest ways lead over these
    ways = (np.take_along_axis(d, nearest, axis=1)[:, :, None] + cells.near[nearest]).reshape(len(Q), -1)
    bound = np.partition(ways, k - 1, axis=1)[:, k - 1] if ways.shape[1] > k else ways.max(axis=1)
    bound = bound + 2 * np.sqrt(np.finfo(float).eps) * scale
    least = np.maximum(d - cells.most[None, :], cells.least[None, :] - d)
    return Reach(d, bound, least <= bound[:, None] + slack, slack)


class InRing:
    """Which pairs of a tile's queries and a batch's rows can be near: the query reaches the row's
    cell, and the row lies in the query's ring around the pivot."""

    def __init__(self, looks: Reach, first: int, home: np.ndarray, gap: np.ndarray):
        self.looks, self.first, self.home, self.gap = looks, first, home, gap

    def each(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q, home = queries - self.first, self.home[rows]
        away = np.abs(self.looks.to_pivot[q, home] - self.gap[rows])
        return self.looks.cells[q, home] & (away <= self.looks.within[q] + self.looks.slack)

    def matrix(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q, home = queries - self.first, self.home[rows]
        away = np.abs(self.looks.to_pivot[np.ix_(q, home)] - self.gap[rows])
        return self.looks.cells[np.ix_(q, home)] & (away <= (self.looks.within[q] + self.looks.slack)[:, None])


class PivotScorer(AllPairs):
    """Scores the rows of the cells a query reaches that lie in its ring around the pivot. Queries go
    by ``TILE``, those of one cell together; what they reach is found anew for every batch, so that
    nothing is held that has an entry for each query and pivot."""

    def __init__(self, cells: Cells, Q: np.ndarray, qids: np.ndarray, k: int):
        home = np.concatenate([cell_of(prepare(Q[at:at + TILE], cells.metric, query=True), cells.pivots)[0] for at in range(0, len(Q), TILE)])
        by = np.argsort(home, kind="stable")
        super().__init__(Q[by], qids[by], k, cells.metric)
        self.cells = cells

    def scan(self, X: np.ndarray, ids: np.ndarray) -> None:
        good = np.isfinite(X).all(axis=1)
        X, ids = X[good], ids[good]
        if not len(X):
            return
        home, gap = cell_of(prepare(X, self.metric), self.cells.pivots)
        by = np.argsort(home, kind="stable")
        X, ids, home, gap = X[by], ids[by], home[by], gap[by]
        here = np.unique(home)
        for at in range(0, len(self.Q), TILE):
            some = np.arange(at, min(len(self.Q), at + TILE))
            looks = reach(self.cells, prepare(self.Q[some], self.metric, query=True), self.k)
            reached = looks.cells.any(axis=0)
            if not reached[here].any():
                continue
            rows = np.flatnonzero(reached[home])
            super().scan(X[rows], ids[rows], InRing(looks, at, home[rows], gap[rows]), some)


@dataclass(frozen=True)
class PivotJoin:
    hits: DataFrame
    pairs: int      # of rows and queries in cells that are reached
    all_pairs: int


def _finite(blocks):
    for qids, Q in blocks:
        fine = np.isfinite(Q).all(axis=1)
        if fine.any():
            yield qids[fine], Q[fine]


def _measured(corpus: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vec_col: str, qid_col: str, qvec_col: str, pivots: int | None):
    """Query blocks, and the cells of the corpus; None where nothing can be found."""
    if metric not in ("l2", "cosine"):
        raise ValueError("pivots are for l2 and cosine")
    spark = corpus.sparkSession
    q = queries.select(F.col(qid_col).cast("long").alias("query_id"), F.col(qvec_col).alias("query_vec"))
    blocks, n, _ = query_blocks(q, conf_int(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES), always=True, k=k)
    return blocks, fit_cells(corpus, k, metric, id_col, vec_col, pivots) if n else None


def _hits(corpus: DataFrame, blocks, cells: Cells | None, k: int, metric: str, id_col: str, vec_col: str, exclude_self: bool) -> DataFrame:
    if cells is None:
        return no_hits(corpus.sparkSession)
    kb = k + exclude_self
    scorer = lambda Q, qids: PivotScorer(cells, Q, qids, kb)
    return broadcast_topk(corpus, _finite(blocks), k, metric, id_col, vec_col, exclude_self, scorer)


def pivot_join(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", *, id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "query_id", qvec_col: str = "query_vec", pivots: int | None = None, exclude_self: bool = False) -> PivotJoin:
    """Exact top-k with pivots, and how many pairs the bounds leave. Queries are broadcast in
    blocks of a checked size; the corpus is read once to measure the cells and once for each
    block, and is never shuffled."""
    if k <= 0:
        raise ValueError("k must be positive")
    kb = k + exclude_self
    blocks, cells = _measured(corpus, queries, kb, metric, id_col, vec_col, qid_col, qvec_col, pivots)
    hits = _hits(corpus, blocks, cells, k, metric, id_col, vec_col, exclude_self)
    asked = pairs = 0
    for _, Q in _finite(blocks) if cells else ():
        asked += len(Q)
        for at in range(0, len(Q), TILE):
            pairs += int((reach(cells, prepare(Q[at:at + TILE], metric, query=True), kb).cells @ cells.rows).sum())
    return PivotJoin(hits, pairs, int(cells.rows.sum()) * asked if cells else 0)


def pivot_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", *, id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "query_id", qvec_col: str = "query_vec", pivots: int | None = None, exclude_self: bool = False) -> DataFrame:
    """The hits of :func:`pivot_join`."""
    if k <= 0:
        raise ValueError("k must be positive")
    blocks, cells = _measured(corpus, queries, k + exclude_self, metric, id_col, vec_col, qid_col, qvec_col, pivots)
    return _hits(corpus, blocks, cells, k, metric, id_col, vec_col, exclude_self)
