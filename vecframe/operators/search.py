"""Exact top-k search over whole query tables.

A search is one DataFrame plan: ``(corpus, queries) -> hits[query_id, rank, id, score]``.

Physical strategies
-------------------
* ``broadcast``: the query table is collected in blocks of at most
  ``vecframe.search.broadcastBytes`` (the size is checked first); each block is shipped as a
  broadcast matrix and every corpus partition is scored in Arrow batches with one matrix
  product per batch (``mapInArrow``). A task keeps a running top-k per query over its
  batches and emits it once, so the single shuffle (on ``query_id``) carries ``k`` rows per
  query and task. The corpus is never shuffled; it is scanned once per query block.
* ``sweep``: more than ``MAX_MOVED`` answers, and a corpus of up to ``MAX_PASSES`` blocks. The
  corpus is broadcast in blocks and a task visits all of them for each part of the queries that
  it reads, so an answer is whole and ranked where it was found and nothing is exchanged.
* ``grid``: more than ``MAX_PASSES`` query blocks. Both sides are split per key into parts:
  a query part holds what a broadcast block would, a corpus part at most
  ``vecframe.search.blockRows`` rows; every pair of parts of a key meets in one cogroup
  task. Keys with few rows are packed together, about half a block to a group. The same
  routine serves the ANN operators, where the key is an LSH bucket or an IVF cell.

One rule for bad input on both paths: a NULL vector, a NULL element or a wrong dimension
raises ``ValueError``; a corpus vector with a NaN or infinite element takes no part, and a
query with one finds nothing.

Ranking is by score best-first, then ``id`` ascending (the reference has no tie-break).
Cosine/IP scores are similarities (higher is better), L2 scores are distances (lower is
better).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecframe.session import (
    BLOCK_ROWS_KEY,
    BROADCAST_BYTES_KEY,
    DEFAULT_BLOCK_ROWS,
    DEFAULT_BROADCAST_BYTES,
    DEFAULT_SMALL_ROWS,
    SMALL_KEYS_KEY,
    conf_int,
    cut_lineage,
    ship_package,
    spread,
)

CANDIDATE_SCHEMA = "query_id long, id long, score double"
HIT_COLUMNS = ["query_id", "rank", "id", "score"]
TILE_PAIRS = 1_000_000  # entries of a score matrix: a few MB, written and compared while in the cache
EXACT_PAIRS = 65_536    # pairs whose vectors are gathered at once
STATE_BYTES = 16 * 1024 * 1024  # of the best rows of the queries that a task holds beside a corpus block
VISIT_ROWS = 16_384     # rows of a corpus block that a task scans at once
MAX_MOVED = 200_000     # answers from which on the corpus is broadcast and the tasks read the queries


def larger_is_better(metric: str) -> bool:
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {metric!r}; use cosine, ip or l2")
    return metric != "l2"


# ---------------------------------------------------------------- numpy block kernels

def stack_vectors(values: pd.Series, dim: int | None = None) -> np.ndarray:
    """Stack an ARRAY column of a pandas frame into an (n, d) float64 matrix, under the same
    rule as :func:`arrow_matrix`."""
    import pyarrow as pa

    if len(values) == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    return arrow_matrix(pa.array(list(values), pa.list_(pa.float64())), dim)


def arrow_matrix(col, dim: int | None = None) -> np.ndarray:
    """(n, d) float64 matrix from an Arrow list column without per-row Python objects: the
    flat values buffer is reshaped after checking that every row has the same length."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    if col.null_count:
        raise ValueError("NULL vector in search input; validate vectors first")
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    d = int(lengths[0])
    if (lengths != d).any() or (dim is not None and d != dim):
        raise ValueError(f"vectors of different dimension in search input (expected {dim})")
    values = col.flatten()
    if values.null_count:
        raise ValueError("NULL element in a vector; validate vectors first")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, d)


def _unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = lengths(m)
    safe = np.where(norms > 0, norms, 1.0)
    return m / safe[:, None], norms


def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def exact_pair_scores(X: np.ndarray, Q: np.ndarray, metric: str, nx: np.ndarray | None = None, nq: np.ndarray | None = None) -> np.ndarray:
    """Score aligned row pairs exactly (used for the emitted candidates only). ``nx`` and ``nq`` are
    their lengths, where these are known."""
    if metric == "l2":
        d = X - Q
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    dots = np.einsum("ij,ij->i", X, Q)
    if metric == "ip":
        return dots
    den = (lengths(X) if nx is None else nx) * (lengths(Q) if nq is None else nq)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(den > 0, dots / np.where(den > 0, den, 1.0), 0.0)
    return out


def _no_candidates() -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})


class Best:
    """The best ``k`` distinct (id, score) rows so far of every query of a block, in arrays of a
    fixed size: 16 bytes for each place, whatever the number of rows seen. New rows wait until
    there are as many as places and are then sorted in at once."""

    def __init__(self, queries: int, k: int, metric: str):
        self.k, self.sign = k, 1.0 if larger_is_better(metric) else -1.0
        self.gain = np.empty((queries, k))  # signed scores, best first
        self.id = np.empty((queries, k), np.int64)
        self.used = np.zeros(queries, np.int64)
        self.worst = np.full(queries, -np.inf)  # of the k-th place, where there is one
        self.last = np.full(queries, np.iinfo(np.int64).max)
        self.room, self.held, self.waiting = max(1024, queries * k), 0, []

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scored rows of the queries numbered ``q``."""
        gain = self.sign * scores
        full = self.used[q] == self.k
        late = full & ((gain < self.worst[q]) | ((gain == self.worst[q]) & (ids >= self.last[q])))
        if late.all():
            return
        self.waiting.append((q[~late], ids[~late], gain[~late]))
        self.held += len(self.waiting[-1][0])
        if self.held >= self.room:
            self.settle()

    def seen(self) -> None:
        """After a batch of rows: queries without ``k`` rows yet have no bound for the next one."""
        if self.held and (self.used < self.k).any():
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        q, ids, gain = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.held, self.waiting = 0, []
        by = np.argsort(q, kind="stable")
        q, ids, gain = q[by], ids[by], gain[by]
        touched, first, new = np.unique(q, return_index=True, return_counts=True)
        used = self.used[touched]
        old = int(used.max())
        wide = old + int(new.max())
        if len(touched) * wide > 4 * (len(q) + int(used.sum())) + 65_536 or not np.isfinite(gain).all():
            return self._merge(touched, q, ids, gain)
        # a row for each query, empty places last
        G, names = np.full((len(touched), wide), -np.inf), np.zeros((len(touched), wide), np.int64)
        have = np.arange(old)[None, :] < used[:, None]
        G[:, :old][have], names[:, :old][have] = self.gain[touched, :old][have], self.id[touched, :old][have]
        row = np.repeat(np.arange(len(touched)), new)
        col = old + np.arange(len(q)) - np.repeat(first, new)
        G[row, col], names[row, col] = gain, ids
        by = np.argsort(-G, axis=1)
        G, names = np.take_along_axis(G, by, axis=1), np.take_along_axis(names, by, axis=1)
        tied = ((G[:, 1:] == G[:, :-1]) & (G[:, 1:] > -np.inf)).any(axis=1)
        if tied.any():  # by id, and the same row only once
            some = tied[row]
            self._merge(touched[tied], q[some], ids[some], gain[some])
        kept = min(self.k, wide)
        sure = touched[~tied]
        self.gain[sure, :kept], self.id[sure, :kept] = G[~tied, :kept], names[~tied, :kept]
        self.used[sure] = np.minimum(self.k, (used + new)[~tied])
        self._bounds(sure)

    def _merge(self, touched: np.ndarray, q: np.ndarray, ids: np.ndarray, gain: np.ndarray) -> None:
        """New rows of the queries ``touched``, in any number, with equal scores and repeats."""
        have = np.arange(self.k)[None, :] < self.used[touched][:, None]
        q = np.concatenate([np.repeat(touched, self.used[touched]), q])
        ids = np.concatenate([self.id[touched][have], ids])
        gain = np.concatenate([self.gain[touched][have], gain])
        order = np.lexsort((ids, -gain, q))
        q, ids, gain = q[order], ids[order], gain[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (gain[1:] != gain[:-1])
        q, ids, gain = q[new], ids[new], gain[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        q, ids, gain, place = q[kept], ids[kept], gain[kept], place[kept]
        self.id[q, place], self.gain[q, place] = ids, gain
        self.used[touched] = np.bincount(np.searchsorted(touched, q), minlength=len(touched))
        self._bounds(touched)

    def _bounds(self, touched: np.ndarray) -> None:
        done = touched[self.used[touched] == self.k]
        self.worst[done], self.last[done] = self.gain[done, -1], self.id[done, -1]

    def rows(self, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries within ``some``, ids and scores, best first."""
        self.settle()
        q, place = np.nonzero(np.arange(self.k)[None, :] < self.used[some][:, None])
        return q, self.id[some][q, place], self.sign * self.gain[some][q, place]

    def frame(self, qids: np.ndarray, some: slice = slice(None)) -> pd.DataFrame:
        q, ids, scores = self.rows(some)
        return pd.DataFrame({"query_id": qids[some][q], "id": ids, "score": scores})

    def parts(self, queries: int) -> Iterable[slice]:
        """Of queries with about 100,000 rows."""
        step = max(1, 100_000 // max(1, self.k))
        return (slice(at, at + step) for at in range(0, queries, step))

    def batches(self, qids: np.ndarray):
        import pyarrow as pa

        for some in self.parts(len(qids)):
            yield pa.RecordBatch.from_pandas(self.frame(qids, some), preserve_index=False)

    def ranked(self, qids: np.ndarray, k: int, exclude_self: bool = False, size: int | None = None):
        """Arrow batches ``[n,] query_id, rank, id, score`` of whole answers."""
        import pyarrow as pa

        for some in self.parts(len(qids)):
            q, ids, scores = self.rows(some)
            if exclude_self:
                other = ids != qids[some][q]
                q, ids, scores = q[other], ids[other], scores[other]
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            kept = rank <= k
            cols = [qids[some][q[kept]], rank[kept].astype(np.int32), ids[kept], scores[kept]]
            names = ["query_id", "rank", "id", "score"]
            if size is not None:
                cols, names = [np.full(len(cols[0]), size, np.int64), *cols], ["n", *names]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def true_places(marks: np.ndarray) -> np.ndarray:
    """Flat places of the true entries, few of many."""
    flat = marks.reshape(-1)
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate([at, np.arange(whole, len(flat))])
    return at[flat[at]]


class AllPairs:
    """Finds the best rows of one block of queries, batch by batch, among the pairs that ``Pairs``
    (see :meth:`scan`) allows. Rows and queries with a non-finite element take no part.

    Candidates come from one matrix product per tile of ``TILE_PAIRS`` pairs. A pair is one if its
    computed score is within a proven error margin of the query's k-th best so far, or, where there
    is none yet or too many pass, of the k-th best of the tile; so no true top-k row is lost.
    Candidates are scored exactly in float64, ``EXACT_PAIRS`` at once, and ranked on those scores,
    which also makes the result independent of how the corpus is cut into batches.

    * cosine and inner product: a float32 product of rows scaled to length at most one (the
      block by its longest row, each query by its own length; neither changes a query's
      order). Such a dot product of length ``d`` is off by at most ``gamma = d * 2^-23``;
      the margin is twice that, once for the row and once for the k-th value.
    * L2: ``2x.q - |x|^2 - |q|^2`` in float64 cancels; its error grows with the norms, so
      the margin is ``4 (d + 4) eps (max|x|^2 + |q|^2)``, after the block and the queries
      have been moved by the block's mean (which changes no distance), and the error of the
      k-th distance, which may be that of a row of another block."""

    def __init__(self, Q: np.ndarray, qids: np.ndarray, k: int, metric: str):
        asks = np.isfinite(Q).all(axis=1)
        self.asked = np.flatnonzero(asks)  # their numbers in the block
        self.Q, self.qids = (Q, qids) if asks.all() else (Q[asks], qids[asks])
        self.k, self.metric = k, metric
        self.best = Best(len(self.Q), k, metric)
        self.space: dict = {}
        if metric != "l2":
            unit, self.length = _unit_rows(self.Q)
            self.Qs = unit.astype(np.float32)
            del unit

    def again(self) -> AllPairs:
        """The same queries without any rows yet."""
        out = copy.copy(self)
        out.best = Best(len(self.Q), self.k, self.metric)
        return out

    def frame(self) -> pd.DataFrame:
        return self.best.frame(self.qids)

    def batches(self):
        return self.best.batches(self.qids)

    def exact(self, X: np.ndarray, ids: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
        """Score these pairs of rows and queries and keep the best."""
        known = lengths(X) if self.metric == "cosine" and X.dtype == np.float64 and len(r) > len(X) else None  # of each row once
        for at in range(0, len(r), EXACT_PAIRS):
            rr, cc = r[at:at + EXACT_PAIRS], c[at:at + EXACT_PAIRS]
            both = () if known is None else (known[rr], self.length[cc])
            self.best.add(cc, ids[rr], exact_pair_scores(X[rr].astype(np.float64, copy=False), self.Q[cc], self.metric, *both))

    def scan(self, X: np.ndarray, ids: np.ndarray, pairs=None, some: np.ndarray | None = None) -> None:
        """Take in a batch of rows, or, for the queries numbered ``some`` alone, in tiles.
        ``pairs``, where given, says which pairs count: ``pairs.matrix(queries, rows)`` for a
        matrix of them and ``pairs.each(queries, rows)`` one by one."""
        good = np.isfinite(X).all(axis=1)
        origin = np.flatnonzero(good)
        if not good.all():
            X, ids = X[good], ids[good]
        nq, b = len(self.Q) if some is None else len(some), len(X)
        if not nq or not b or self.k <= 0:
            return
        wide = max(2048, 8 * self.k)
        step = max(1, TILE_PAIRS // min(b, wide))
        for r0 in range(0, b, wide):
            rows = slice(r0, min(b, r0 + wide))
            near = self._near(X[rows])
            for q0 in range(0, nq, step):
                which = np.arange(q0, min(nq, q0 + step)) if some is None else some[q0:q0 + step]
                c, r = self._candidates(near, which, ids[rows], pairs, origin[rows])
                self.exact(X[rows], ids[rows], r, which[c])
            self.best.seen()

    def _room(self, name: str, shape: tuple[int, int], kind) -> np.ndarray:
        """A matrix in memory that every tile uses anew."""
        size = shape[0] * shape[1]
        if name not in self.space or len(self.space[name]) < size or self.space[name].dtype != kind:
            self.space[name] = np.empty(size, kind)
        return self.space[name][:size].reshape(shape)

    def _near(self, X: np.ndarray):
        """Rows prepared for the matrix product."""
        if self.metric == "l2":
            middle = X.mean(axis=0)
            Xs = X - middle
            sq = np.einsum("ij,ij->i", Xs, Xs)
            return np.column_stack([Xs, -0.5 * sq]).T, middle, float(sq.max()), float(np.abs(X).max())
        if self.metric == "cosine":
            return _unit_rows(X)[0].astype(np.float32).T, 1.0
        longest = float(np.sqrt(np.einsum("ij,ij->i", X, X).max()))
        return (X / longest if longest > 0 else X).astype(np.float32).T, longest if longest > 0 else 1.0

    def _tile(self, near, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Computed scores, higher is better; per query its k-th best so far in the same measure
        (minus infinity where there is none) and the margin."""
        worst = self.best.worst[which]
        d = self.Q.shape[1]
        if self.metric == "l2":
            eps = np.finfo(np.float64).eps
            Xt, middle, xsq, xmax = near
            Q = self.Q[which]
            Qs = Q - middle
            qsq = np.einsum("ij,ij->i", Qs, Qs)
            S = np.column_stack([Qs, np.ones(len(Qs))]) @ Xt  # half of |q|^2 minus the squared distance
            reach = xmax + np.abs(Q).max(axis=1)  # moving by the mean rounds each element once more
            gap = np.where(np.isfinite(worst), worst, 0.0) ** 2
            margins = 4.0 * (d + 4) * eps * (xsq + qsq + gap) + 4.0 * d * eps * reach * (np.sqrt(xsq) + np.sqrt(qsq))
            return S, np.where(np.isfinite(worst), 0.5 * (qsq - gap), -np.inf), margins
        S = np.matmul(self.Qs[which], near[0], out=self._room("scores", (len(which), near[0].shape[1]), np.float32))
        if self.metric == "ip":
            length = self.length[which]
            with np.errstate(over="ignore", invalid="ignore"):
                worst = worst / near[1] / np.where(length > 0, length, 1.0)
        return S, np.where(np.isfinite(worst), worst, -np.inf), np.full(len(which), 2.02 * (d + 2) * 2.0 ** -23)

    def _candidates(self, near, which: np.ndarray, ids: np.ndarray, pairs, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        S, cut, margins = self._tile(near, which)
        b = S.shape[1]
        deep = np.isneginf(cut)
        if self.metric != "l2":
            flat = np.flatnonzero(self.length[which] == 0)  # score zero with every row: the least ids are the best
            if len(flat):
                S[flat] = -np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                deep[flat], cut[flat] = True, -np.inf
        floor = np.where(deep, np.inf, cut - margins)
        # a float32 floor may not rise
        floor = np.nextafter(floor.astype(S.dtype), S.dtype.type(-np.inf)) if S.dtype != floor.dtype else floor
        hit = np.greater_equal(S, floor[:, None], out=self._room("hits", S.shape, bool))
        if not deep.all() and np.count_nonzero(hit) > 4 * self.k * len(which):
            deep |= np.count_nonzero(hit, axis=1) > 4 * self.k + 64
        at = np.flatnonzero(deep)
        if len(at):
            whole = len(at) == len(which)
            part = S if whole else S[at]
            if pairs is not None:
                open_ = pairs.matrix(self.asked[which[at]], rows)
                part = np.where(open_, part, part.dtype.type(-np.inf))
            if self.k < b:
                kth = np.partition(part, b - self.k, axis=1)[:, b - self.k].astype(np.float64)
                least = np.maximum(kth - margins[at], cut[at] - margins[at])
                found = part >= np.nextafter(least.astype(S.dtype), S.dtype.type(-np.inf))[:, None]
            else:
                found = np.ones(part.shape, bool)
            if pairs is not None:
                found &= open_
            if whole:
                hit = found
            else:
                hit[at] = found
        places = true_places(hit)
        c, r = places // b, places % b
        if pairs is not None:
            fine = deep[c]
            fine[~fine] = pairs.each(self.asked[which[c[~fine]]], rows[r[~fine]])
            c, r = c[fine], r[fine]
        return c, r


def block_topk(X: np.ndarray, ids: np.ndarray, Q: np.ndarray, qids: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """Best ``k`` rows of this block for every query; see :class:`AllPairs`."""
    found = AllPairs(Q, qids, k, metric)
    found.scan(X, ids)
    return found.frame()


def prune(cands: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The ``k`` best distinct (id, score) of each query of a candidate frame."""
    cands = cands.drop_duplicates()
    key = cands["score"].to_numpy() * (-1.0 if larger_is_better(metric) else 1.0)
    order = np.lexsort((cands["id"].to_numpy(), key, cands["query_id"].to_numpy()))
    cands = cands.iloc[order]
    place = cands.groupby("query_id", sort=False).cumcount()
    return cands[(place < k).to_numpy()]


def row_blocks(batches, dim: int, least: int = 8192):
    """(rows, ids) of Arrow batches, small batches put together."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.select(["id", "vec"]))
            n += batch.num_rows
        if n >= least:
            yield _rows(pa.Table.from_batches(held), dim)
            held, n = [], 0
    if n:
        yield _rows(pa.Table.from_batches(held), dim)


def _rows(table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return arrow_matrix(table["vec"], dim), table["id"].to_numpy().astype(np.int64, copy=False)


# ---------------------------------------------------------------- ranking

def rank_candidates(cands: DataFrame, k: int, metric: str, part_cols: Sequence[str] = ("query_id",),
                    exclude_self: bool = False) -> DataFrame:
    """Final top-k per query over candidate rows (duplicates of a pair collapse). Rows that have a
    ``rank`` are whole answers, ranked in the task that found them, and stay as they are.

    ``dense_rank`` gives equal (score, id) duplicates the same rank, so filtering on it and
    then dropping duplicates is exact. Spark plans a partial ``WindowGroupLimit`` before the
    shuffle, and the de-duplication reuses the window's partitioning.
    """
    if "rank" in cands.columns:
        return cands.select(*part_cols, "rank", "id", "score")
    if exclude_self:
        cands = cands.filter(F.col("id") != F.col("query_id"))
    order = F.desc("score") if larger_is_better(metric) else F.asc("score")
    w = Window.partitionBy(*part_cols).orderBy(order, F.asc("id"))
    ranked = cands.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates([*part_cols, "id"]).select(*part_cols, "rank", "id", "score")


# ---------------------------------------------------------------- strategies

MAX_PASSES = 16       # query blocks up to which the corpus is scanned once per block
SMALL_QUERIES = 2048  # rows of a query table that one job collects and checks

Block = tuple[np.ndarray, np.ndarray]  # query ids and their vectors


def _query_stats(queries: DataFrame, qvec_col: str) -> tuple[int, int, int]:
    row = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(F.size(qvec_col), F.lit(-1))).alias("dmax"),
        # a NULL vector or element counts as no vector
        F.min(F.when(F.col(qvec_col).isNull() | F.exists(qvec_col, lambda x: x.isNull()), -1).otherwise(F.size(qvec_col))).alias("dmin"),
    ).first()
    return int(row["n"]), int(row["dmax"] or 0), int(row["dmin"] or 0)


def check_queries(n: int, dmax: int, dmin: int) -> None:
    if n and dmin <= 0:
        raise ValueError("a query has no complete vector")
    if n and dmin != dmax:
        raise ValueError(f"query vectors of different dimension ({dmin} .. {dmax})")


def _block(table) -> Block:
    Q = arrow_matrix(table["query_vec"])
    if len(Q) and not Q.shape[1]:
        raise ValueError("a query has no complete vector")
    return table["query_id"].to_numpy().astype(np.int64, copy=False), Q


class Blocks:
    """Query blocks in turn; only the one asked for is in the driver's memory."""

    def __init__(self, queries: DataFrame, count: int):
        self.dealt, self.count = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(count))), count

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> Block:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return _block(self.dealt.where(F.col("_b") == i).drop("_b").toArrow())

    def __iter__(self):
        return (b for b in map(self.__getitem__, range(self.count)) if len(b[0]))


def query_bytes(dim: int, k: int = 0) -> int:
    """Bytes that a query of a block takes in a task: its vector or its ``k`` best rows."""
    return max(8 * dim, 16 * k)


def query_blocks(queries: DataFrame, bound: int, always: bool = False, k: int = 0) -> tuple[Sequence[Block] | Blocks | None, int, int]:
    """``queries(query_id, query_vec)`` in blocks of about ``bound`` bytes, with room for the ``k``
    best rows of each query, and their number and dimension. Beyond ``MAX_PASSES`` blocks there
    are none, unless ``always`` asked for.

    A table of up to SMALL_QUERIES rows is collected by one job, so that what makes its
    vectors (an embedder, say) runs once. A larger one is measured first; its blocks are dealt
    by a hash of the query id and collected one at a time."""
    few = queries.limit(SMALL_QUERIES + 1).toArrow()
    if few.num_rows <= SMALL_QUERIES:
        qids, Q = _block(few)
        n, dim = Q.shape
        count = max(1, -(-(n * query_bytes(dim, k)) // max(1, bound)))
        if count > MAX_PASSES and not always:
            return None, n, dim
        return [(qids[i::count], Q[i::count]) for i in range(count) if i < n], n, dim
    del few
    n, dim, least = _query_stats(queries, "query_vec")
    check_queries(n, dim, least)
    count = max(1, -(-(n * query_bytes(dim, k)) // max(1, bound)))
    if count > MAX_PASSES and not always:
        return None, n, dim
    if count == 1:
        return [_block(queries.toArrow())], n, dim
    return Blocks(queries, count), n, dim


# of (queries, query ids): an :class:`AllPairs` or what scans and gives batches like one
Scorer = Callable[[np.ndarray, np.ndarray], AllPairs]


def block_bytes(spark: SparkSession) -> int:
    return conf_int(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES)


def broadcast_candidates(corpus: DataFrame, block: Block, k: int, metric: str, id_col: str, vec_col: str,
                         scorer: Scorer | None = None) -> DataFrame:
    """Per task the best ``k`` corpus rows of every query of one block. ``scorer``, called in
    the task, gives what scans the rows; without one all pairs are scored."""
    spark = corpus.sparkSession
    ship_package(spark)
    dim = block[1].shape[1]
    bq = spark.sparkContext.broadcast(block)

    def score(batches):
        qids, Q = bq.value
        found = scorer(Q, qids) if scorer else AllPairs(Q, qids, k, metric)
        for X, ids in row_blocks(batches, dim):
            found.scan(X, ids)
        yield from found.batches()

    # Arrow batches in and out: vectors reach numpy as one reshaped buffer per batch
    return spread(corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))).mapInArrow(
        score, CANDIDATE_SCHEMA
    )


def broadcast_topk(corpus: DataFrame, blocks: Iterable[Block], k: int, metric: str, id_col: str, vec_col: str,
                   exclude_self: bool = False, scorer: Scorer | None = None) -> DataFrame:
    """Top-k of all blocks; the corpus is scanned once for each."""
    kb = k + 1 if exclude_self else k
    cands = None
    for block in blocks:
        part = broadcast_candidates(corpus, block, kb, metric, id_col, vec_col, scorer)
        cands = part if cands is None else cands.unionByName(part)
    return no_hits(corpus.sparkSession) if cands is None else rank_candidates(cands, k, metric, exclude_self=exclude_self)


def knn_within_keys(
    corpus: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    k: int,
    metric: str = "cosine",
    *,
    block_rows: int | None = None,
    query_rows: int | None = None,
    max_keys: int | None = None,
    finalize: bool = True,
    exclude_self: bool = False,
) -> DataFrame:
    """Top-k per query among corpus rows that share the key columns with the query.

    ``corpus`` has ``id, vec, *keys``; ``queries`` has ``query_id, query_vec, *keys``.
    Hot keys are split: a key with ``cn`` corpus rows and ``qn`` query rows becomes
    ``ceil(qn/Q) x ceil(cn/B)`` groups of about ``B`` corpus and ``Q`` query rows. Keys with
    at most ``B/8`` corpus rows are packed by a hash, half a block to a group on average.
    ``max_keys`` is the proven bound on the number of distinct keys (for example
    ``bands x 2^bits``); the per-key statistics are broadcast if it is within
    ``vecframe.smallFrameRows``.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    B = block_rows or conf_int(spark, BLOCK_ROWS_KEY, DEFAULT_BLOCK_ROWS)
    keys = list(keys)
    kb = k + 1 if exclude_self else k
    if max_keys is not None and max_keys > conf_int(spark, SMALL_KEYS_KEY, DEFAULT_SMALL_ROWS):
        max_keys = None
    q, c = salted_sides(corpus, queries, keys, B, max_keys, query_rows)
    q, c = packed(q, c, keys, B, corpus.count())

    def score(left, right):
        import pyarrow as pa

        found = []
        if left.num_rows and right.num_rows:
            Q = arrow_matrix(left.column("query_vec"))
            X = arrow_matrix(right.column("vec"), Q.shape[1])
            qids = left.column("query_id").to_numpy()
            ids = right.column("id").to_numpy()
            by_key = right.select(keys).to_pandas().groupby(keys, sort=False).indices
            for key, qi in left.select(keys).to_pandas().groupby(keys, sort=False).indices.items():
                if key in by_key:
                    xi = by_key[key]
                    found.append(block_topk(X[xi], ids[xi], Q[qi], qids[qi], kb, metric))
        out = pd.concat(found, ignore_index=True) if found else _no_candidates()
        return pa.Table.from_pandas(out, preserve_index=False)

    group = ["_g", "_qs", "_cs"]
    cands = q.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(score, CANDIDATE_SCHEMA)
    return rank_candidates(cands, k, metric, exclude_self=exclude_self) if finalize else cands


def packed(q: DataFrame, c: DataFrame, keys: Sequence[str], B: int, corpus_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the group ``_g``: keys with at most ``B/8`` corpus rows share
    ``2 * corpus_rows / B`` groups by a hash of the key, so a group holds half a block on
    average (4 blocks with a chance below 1e-5); any other key is a group of its own."""
    groups = max(1, -(-2 * corpus_rows // B))
    own = F.xxhash64(*keys)
    g = F.when(F.col("_cn") * 8 <= B, F.pmod(own, F.lit(groups))).otherwise(own).alias("_g")
    return q.select(g, *[x for x in q.columns if x != "_cn"]), c.select(g, *[x for x in c.columns if x != "_cn"])


def salted_sides(corpus: DataFrame, queries: DataFrame, keys: Sequence[str], B: int,
                 max_keys: int | None = None, query_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with salts ``(_qs, _cs)`` and the key's corpus rows ``_cn``: per key,
    ``ceil(qn/query_rows)`` query parts (``B`` by default) and ``ceil(cn/B)`` corpus parts; a query row is repeated once per corpus part and a corpus
    row once per query part, so every (query part, corpus part) pair meets exactly once."""
    keys = list(keys)
    qstats = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"))
    cstats = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cn"))
    stats = qstats.join(cstats, keys).select(
        *keys,
        "_cn",
        F.ceil(F.col("_qn") / (query_rows or B)).cast("int").alias("_sq"),
        F.ceil(F.col("_cn") / B).cast("int").alias("_sc"),
    )
    if max_keys is not None:
        stats = F.broadcast(stats)
    q = (
        queries.join(stats, keys)
        .withColumn("_qs", F.pmod(F.xxhash64("query_id"), F.col("_sq")).cast("int"))
        .withColumn("_cs", F.explode(F.sequence(F.lit(0), F.col("_sc") - 1)))
        .select(*keys, "_cn", "_qs", "_cs", "query_id", "query_vec")
    )
    c = (
        corpus.join(stats, keys)
        .withColumn("_cs", F.pmod(F.xxhash64("id"), F.col("_sc")).cast("int"))
        .withColumn("_qs", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1)))
        .select(*keys, "_cn", "_qs", "_cs", "id", "vec")
    )
    return q, c


def no_hits(spark: SparkSession, sizes: Sequence[int] | None = None) -> DataFrame:
    return spark.createDataFrame([], ("n long, " if sizes else "") + "query_id long, rank int, id long, score double")


class Sweep:
    """A corpus broadcast in blocks that a task visits in turn, in bands of ids that end below each of
    ``sizes`` (one band without). Blocks leave the task's memory one by one where there are several.
    Given to searches in place of the sizes, it serves them all."""

    def __init__(self, bands: list, sizes: Sequence[int] | None, dim: int):
        self.bands, self.sizes, self.dim = bands, sizes, dim
        self.several = sum(map(len, bands)) > 1

    def __len__(self) -> int:
        return len(self.bands)

    def __iter__(self):
        return iter(self.sizes or [])

    def blocks(self, *bands: int):
        """(rows, ids) of the blocks of some bands, rows of the table's own type."""
        for band in bands:
            for shared in self.bands[band]:
                ids, X = shared.value
                yield X, ids
                del ids, X
                if self.several:
                    vars(shared).pop("_value", None)  # read again from the executor's disk when it is its turn

    def visit(self, band: int):
        """(rows, ids) of a band, some at a time."""
        for X, ids in self.blocks(band):
            for at in range(0, len(ids), VISIT_ROWS):
                yield X[at:at + VISIT_ROWS].astype(np.float64), ids[at:at + VISIT_ROWS]
            del X, ids

    def named(self):
        """(band, size) in rising order."""
        return enumerate(self.sizes if self.sizes else [None])


def sweep_of(corpus: DataFrame, queries: DataFrame, n: int, k: int, dim: int, sizes: Sequence[int] | Sweep | None = None) -> Sweep | None:
    """``corpus(id, vec)`` for the tasks that read ``queries(query_id, query_vec)``, where there are
    more than ``MAX_MOVED`` answers and the corpus fits into ``MAX_PASSES`` blocks. There is none
    where ids repeat or are NULL: such answers are put together by a shuffle."""
    if isinstance(sizes, Sweep):
        return sizes
    if n * k * len(sizes or [1]) <= MAX_MOVED:
        return None
    spark = corpus.sparkSession
    if sizes:
        corpus = corpus.where(F.col("id") < sizes[-1])
    band = F.lit(0)
    for s in (sizes or [])[:-1]:
        band = band + (F.col("id") >= s).cast("int")
    corpus = corpus.withColumn("_band", band)
    size = F.coalesce(F.size("vec"), F.lit(-1))
    whole = F.when(F.exists("vec", lambda x: x.isNull()), -1).otherwise(size)
    stats = corpus.groupBy("_band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(whole).alias("least"),
                                        F.max(size).alias("most")).collect()
    if any(r["least"] != dim or r["most"] != dim for r in stats):
        raise ValueError(f"corpus vectors without {dim} complete elements")
    single = corpus.schema["vec"].dataType.elementType.simpleString() == "float"
    per_block = max(1, block_bytes(spark) // ((4 if single else 8) * dim))
    counts = {r["_band"]: -(-r["n"] // per_block) for r in stats}
    if sum(counts.values()) > MAX_PASSES + len(sizes or []):
        return None
    if any(r["ids"] != r["n"] for r in stats) or queries.agg(F.count_distinct("query_id")).first()[0] != n:
        return None
    bands = []
    for i in range(len(sizes or [1])):
        rows = corpus.where(F.col("_band") == i).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
        blocks = ((ids, X.astype(np.float32) if single else X) for ids, X in Blocks(rows, max(1, counts.get(i, 0))))
        bands.append([spark.sparkContext.broadcast(block) for block in blocks])
    return Sweep(bands, sizes, dim)


def swept(queries: DataFrame, sweep: Sweep, k: int, answer) -> DataFrame:
    """What ``answer(query vectors, query ids)`` gives for the queries of each task, with room for
    ``k`` rows a query: Arrow batches of whole answers."""
    ship_package(queries.sparkSession)
    step = max(1, STATE_BYTES // (16 * k))

    def run(batches):
        named = (b.rename_columns(["id", "vec"]) for b in batches)
        for Q, qids in row_blocks(named, sweep.dim):
            for at in range(0, len(Q), step):
                yield from answer(Q[at:at + step], qids[at:at + step])

    return spread(queries).mapInArrow(run, ("n long, " if sweep.sizes else "") + "query_id long, rank int, id long, score double")


def swept_topk(queries: DataFrame, sweep: Sweep, k: int, metric: str, exclude_self: bool = False, scorer: Scorer | None = None) -> DataFrame:
    """Ranked top-k of every query, for each size of ``sweep``: the rows below a size are those of the
    bands up to it, so one pass over the bands in rising order answers every size."""
    kb = k + 1 if exclude_self else k

    def answer(Q, qids):
        found = scorer(Q, qids) if scorer else AllPairs(Q, qids, kb, metric)
        for band, size in sweep.named():
            for X, ids in sweep.visit(band):
                found.scan(X, ids)
            yield from found.best.ranked(found.qids, k, exclude_self, size)

    return swept(queries, sweep, kb, answer)


def rescored_answers(Q: np.ndarray, qids: np.ndarray, cands: list[tuple[np.ndarray, np.ndarray]], sweep: Sweep, k: int, metric: str):
    """In a task, for each size of ``sweep``: the exact top-k of candidate pairs ``(number of the query,
    id)``, whose vectors are found in the corpus blocks."""
    found = AllPairs(Q, qids, k, metric)
    place = np.full(len(Q), -1)
    place[found.asked] = np.arange(len(found.asked))
    each = [found.again() for _ in cands]
    for X, ids in sweep.blocks(*range(len(sweep.bands))):
        by = np.argsort(ids)
        sorted_ids = ids[by]
        for one, (q, wanted) in zip(each, cands, strict=True):
            at = np.minimum(np.searchsorted(sorted_ids, wanted), len(ids) - 1)
            here = np.flatnonzero((sorted_ids[at] == wanted) & (place[q] >= 0))
            for some in np.array_split(here, max(1, -(-len(here) // EXACT_PAIRS))):
                r = by[at[some]]
                fine = np.isfinite(X[r]).all(axis=1)
                one.exact(X, ids, r[fine], place[q[some[fine]]])
        del X, ids
    for one, (_, size) in zip(each, sweep.named(), strict=True):
        yield from one.best.ranked(one.qids, k, size=size)


def rising(sizes: Sequence[int] | Sweep) -> Sequence[int] | Sweep:
    return sizes if isinstance(sizes, Sweep) else sorted({int(s) for s in sizes})


def by_size(search: Callable[[DataFrame], DataFrame], corpus: DataFrame, sizes: Sequence[int], id_col: str) -> DataFrame:
    """``search`` of each prefix ``id < n`` of the corpus."""
    out = None
    for n in sizes:
        hits = search(corpus.where(F.col(id_col) < n)).select(F.lit(n).cast("long").alias("n"), *HIT_COLUMNS)
        out = hits if out is None else out.unionByName(hits)
    return out


def exact_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    qid_col: str = "query_id",
    qvec_col: str = "query_vec",
    strategy: str = "auto",
    exclude_self: bool = False,
    sizes: Sequence[int] | Sweep | None = None,
) -> DataFrame:
    """Exact top-k for every row of ``queries`` (T1, T2, T7, T11). With ``sizes`` every prefix ``id < n``
    of the corpus is searched and hits have their ``n``.

    Returns ``hits[query_id, rank, id, score]``; ``k > N`` gives ``N`` hits, an empty
    corpus gives none. An empty or ill-sized query vector raises ``ValueError`` (T12).
    """
    larger_is_better(metric)
    if k <= 0:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    sizes = rising(sizes) if sizes else None
    kb = k + 1 if exclude_self else k
    q = queries.select(F.col(qid_col).cast("long").alias("query_id"), F.col(qvec_col).alias("query_vec"))
    c = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    bound = block_bytes(spark)
    blocks, n, dim = query_blocks(q, bound, always=strategy == "broadcast", k=kb)
    if n == 0:
        return no_hits(spark, sizes)
    sweep = sweep_of(c, q, n, kb, dim, sizes) if strategy == "auto" else None
    if sweep is not None:
        return rank_candidates(swept_topk(q, sweep, k, metric, exclude_self), k, metric, ("n", "query_id") if sizes else ("query_id",))
    if sizes:
        return by_size(lambda some: exact_topk(some, q, k, metric, id_col=id_col, vec_col=vec_col, strategy=strategy, exclude_self=exclude_self),
                       corpus, sizes, id_col)
    if blocks is not None and strategy in ("broadcast", "auto"):
        return broadcast_topk(corpus, blocks, k, metric, id_col, vec_col, exclude_self)
    return knn_within_keys(c.withColumn("_all", F.lit(0)), q.withColumn("_all", F.lit(0)), ["_all"], k, metric, max_keys=1,
                           query_rows=max(1, bound // query_bytes(dim, kb)), exclude_self=exclude_self)


# ---------------------------------------------------------------- derived searches

MAX_BROADCAST_HITS = 2_000_000


def hit_bound(queries: DataFrame, k: int) -> int:
    """Proven upper bound of a hit table: ``k`` rows per query row."""
    return queries.count() * k


def lookup_payload(hits: DataFrame, corpus: DataFrame, id_col: str, payload: dict[str, str],
                   max_hit_rows: int | None = None) -> DataFrame:
    """Join payload columns onto hits by id; a missing id gives NULL.

    Late materialisation: text never travels through scoring, it is joined onto the
    ``k`` rows per query only. When the hit count is bounded (``max_hit_rows``, e.g. from
    :func:`hit_bound`) the distinct hit ids are broadcast to the corpus, which is scanned
    once and never shuffled; only the rows found meet the hits. Otherwise the planner
    decides.
    """
    side = corpus.select(F.col(id_col).cast("long").alias("id"), *[F.col(src).alias(dst) for dst, src in payload.items()])
    if max_hit_rows is not None and max_hit_rows <= MAX_BROADCAST_HITS:
        side = side.join(F.broadcast(hits.select("id").distinct()), "id")
    return hits.join(side, "id", "left").select(*hits.columns, *payload.keys())


def lookup_vectors(cand: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, bound: int | None) -> DataFrame:
    """Candidate pairs ``(query_id, id)`` with the row's vector ``_v``. A proven number of pairs
    is broadcast to the vectors, which are then not shuffled; otherwise the planner decides."""
    side = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v"))
    if bound is not None and bound <= MAX_BROADCAST_HITS:
        return spread(side).join(F.broadcast(cand), "id").select("query_id", "id", "_v")
    return cand.join(side, "id").select("query_id", "id", "_v")


def search_with_fallback(primary: DataFrame, fallback: DataFrame | Callable[[DataFrame], DataFrame],
                         queries: DataFrame | None = None) -> DataFrame:
    """Per query, the first non-empty answer wins (T6). ``fallback`` is a second hit table,
    or a search that is given only those rows of ``queries`` that the primary search left
    unanswered (its hits are then written once and read twice)."""
    if callable(fallback):
        primary = cut_lineage(primary)
    answered = primary.select("query_id").distinct()
    if callable(fallback):
        rest = fallback(cut_lineage(queries.join(answered, "query_id", "left_anti")))
    else:
        rest = fallback.join(answered, "query_id", "left_anti")
    return primary.withColumn("source", F.lit("primary")).unionByName(rest.withColumn("source", F.lit("fallback")))


def unify_hits(named_hits: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Stack hit lists of several searchers into one table with the score direction."""
    out = None
    for name, (hits, metric) in named_hits.items():
        h = hits.select(
            F.lit(name).alias("searcher"), "query_id", "rank", "id", "score",
            F.lit("desc" if larger_is_better(metric) else "asc").alias("direction"),
        )
        out = h if out is None else out.unionByName(h)
    return out


def self_hit_check(hits: DataFrame) -> DataFrame:
    """Diagnostic: a stored vector used as query must come back first."""
    first = hits.filter(F.col("rank") == 1)
    return first.select(
        "query_id",
        F.col("id").alias("top_id"),
        "score",
        (F.col("id") == F.col("query_id")).alias("self_first"),
    )


def size_sweep_topk(
    corpus: DataFrame, queries: DataFrame, sizes: Sequence[int] | Sweep, k: int = 5, metric: str = "cosine",
    *, id_col: str = "id", vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "query_vec",
) -> DataFrame:
    """Top-k over nested corpus prefixes ``id < n`` for every ``n`` in ``sizes``.

    The corpus is scanned once per query block (one block up to
    ``vecframe.search.broadcastBytes`` of queries). The sizes cut the ids into disjoint bands;
    a row is scored once, in its band, and a prefix's answer is merged from the ``k`` best
    rows of each of its bands.
    """
    larger_is_better(metric)
    spark = corpus.sparkSession
    q = queries.select(F.col(qid_col).cast("long").alias("query_id"), F.col(qvec_col).alias("query_vec"))
    blocks, n, dim = query_blocks(q, block_bytes(spark), always=True, k=k * len(set(sizes)))
    if n == 0:
        return no_hits(spark, sizes or [0])
    ship_package(spark)
    sizes = rising(sizes)
    if not sizes:
        raise ValueError("no sizes")
    sweep = sweep_of(corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), q, n, k, dim, sizes)
    if sweep is not None:
        return rank_candidates(swept_topk(q, sweep, k, metric), k, metric, ("n", "query_id"))
    rows = spread(corpus.where(F.col(id_col) < sizes[-1]).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")))
    bands = None
    for block in blocks:
        part = _band_candidates(rows, block, sizes, k, metric)
        bands = part if bands is None else bands.unionByName(part)
    order = F.desc("score") if larger_is_better(metric) else F.asc("score")
    best = Window.partitionBy("query_id", "band").orderBy(order, F.asc("id"))
    lists = bands.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k)  # repeats go at the end
    # a prefix ends with its band, so a band's k best are candidates of that prefix and all longer ones
    within = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s > F.col("id"))
    return rank_candidates(lists.select(F.explode(within).alias("n"), "query_id", "id", "score"), k, metric, part_cols=("n", "query_id"))


def _band_candidates(rows: DataFrame, block: Block, sizes: Sequence[int], k: int, metric: str) -> DataFrame:
    """Per task, query and band the best ``k`` rows; band i holds the ids from size i - 1 up to
    size i, so a row is scored once, whatever the number of sizes."""
    bq = rows.sparkSession.sparkContext.broadcast(block)

    def score(batches):
        import pyarrow as pa

        qids, Q = bq.value
        one = AllPairs(Q, qids, k, metric)
        best = [one.again() for _ in sizes]
        for X, ids in row_blocks(batches, Q.shape[1]):
            band = np.searchsorted(sizes, ids, side="right")
            for i in np.unique(band):
                best[i].scan(X[band == i], ids[band == i])
        for i, found in enumerate(best):
            for part in found.batches():
                numbers = pa.array(np.full(part.num_rows, i, np.int32))
                yield pa.RecordBatch.from_arrays([numbers, *part.columns], names=["band", *part.schema.names])

    return rows.mapInArrow(score, "band int, " + CANDIDATE_SCHEMA)
