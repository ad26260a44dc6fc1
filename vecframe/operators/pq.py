"""Product-quantised inverted file (T4): an index that is built once, saved and searched often.

Vectors are kept by cell (nearest coarse centroid); what is left of a vector after its centroid
is cut into subspaces, and each part is replaced by the number of the nearest entry of that
subspace's codebook, so a row is ``subspaces`` bytes. The saved index is Parquet partitioned by
cell: a search reads the ids and codes of probed cells only, and then the vectors of the
candidates alone.

A search sums, per row, the entries of its query's distance tables (subspace by code); the
``rerank`` nearest rows of every query by that sum are scored exactly. Where there are many
answers and the vectors fit into a few blocks, these and the codes are broadcast and a task finds
whole answers for the queries it reads: candidates do not leave it. How many cells to probe and
how many rows to score again can be calibrated on the index's own vectors.

Codebooks are fitted on a bounded sample (``TRAIN_ROWS``); every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecframe.operators.ann import KeyedScorer, rescored
from vecframe.operators.search import (
    MAX_BROADCAST_HITS,
    VISIT_ROWS,
    Block,
    arrow_matrix,
    exact_topk,
    no_hits,
    packed,
    query_blocks,
    rescored_answers,
    salted_sides,
    swept,
    sweep_of,
)
from vecframe.session import BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES, conf_int, ship_package

TRAIN_ROWS = 20_000   # sampled by a hash of the vector; at most twice as many are collected
CODES = 256           # entries of a codebook: one byte
ROUNDS = 12
TILE = 512            # queries whose tables are made at once
CALIBRATION_ROWS = 256
GRID_ROWS = 65_536    # rows of a cell in one group, where queries are too many to broadcast


# ------------------------------------------------------------------ codebooks


def lloyd(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``rows`` by squared distance; fewer than ``k`` where fewer rows are distinct.
    A centre that loses its rows moves to the row farthest from its own."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(7).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        home, gap = nearest(rows, centres)
        count = np.bincount(home, minlength=k)
        sums = np.stack([np.bincount(home, rows[:, d], minlength=k) for d in range(rows.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        centres[lost] = rows[np.argsort(-gap, kind="stable")[: len(lost)]]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it."""
    d = (rows * rows).sum(axis=1)[:, None] - 2.0 * rows @ centres.T + (centres * centres).sum(axis=1)[None, :]
    home = d.argmin(axis=1)
    return home, np.maximum(d[np.arange(len(rows)), home], 0.0)


@dataclass(frozen=True)
class PQModel:
    metric: str              # cosine (vectors scaled to length one) or l2
    centres: np.ndarray      # (cells, dim)
    books: list[np.ndarray]  # per subspace (codes, width)

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def prepare(self, X: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return X
        length = np.sqrt((X * X).sum(axis=1, keepdims=True))
        return X / np.where(length > 0, length, 1.0)

    def encode(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, codes) of prepared rows."""
        cell, _ = nearest(X, self.centres)
        rest, cuts = X - self.centres[cell], self.cuts
        parts = [nearest(rest[:, a:b], book)[0] for a, b, book in zip(cuts, cuts[1:], self.books, strict=False)]
        return cell, np.stack(parts, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1) + self.centres[cell]

    def probes(self, Q: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells nearest to each prepared query."""
        d = (self.centres * self.centres).sum(axis=1)[None, :] - 2.0 * Q @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def distances(self, Q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of prepared queries to coded rows of one cell: sums of table
        entries, or, where the cell has fewer rows than tables have entries, of decoded rows."""
        cuts = self.cuts
        if len(codes) < CODES:
            rows = self.decode(cell, codes)
            return (Q * Q).sum(axis=1)[:, None] - 2.0 * Q @ rows.T + (rows * rows).sum(axis=1)[None, :]
        rest = Q - self.centres[cell]
        total = np.zeros((len(Q), len(codes)), np.float32)  # the answer is scored again, exactly
        for j, book in enumerate(self.books):
            part = rest[:, cuts[j] : cuts[j + 1]]
            table = (part * part).sum(axis=1)[:, None] - 2.0 * part @ book.T + (book * book).sum(axis=1)[None, :]
            total += np.take(table.astype(np.float32), codes[:, j], axis=1)
        return total


def fit_pq(vectors: DataFrame, vec_col: str = "embedding", *, cells: int, subspaces: int, metric: str = "cosine",
           train_rows: int = TRAIN_ROWS) -> PQModel:
    """Coarse centroids and codebooks from about ``train_rows`` vectors, the same whatever the
    partitioning. Vectors must have one dimension and no nulls."""
    if metric not in ("cosine", "l2"):
        raise ValueError("the index is for cosine and l2")
    rows = vectors.select(F.col(vec_col).alias("v"))
    share = min(1.0, train_rows / max(1, rows.count()))
    if share < 1.0:
        rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    X = arrow_matrix(rows.limit(2 * train_rows).toArrow()["v"])
    X = X[np.isfinite(X).all(axis=1)]
    if not len(X) or not X.shape[1]:
        raise ValueError("no vectors to fit an index on")
    if not 1 <= subspaces <= X.shape[1]:
        raise ValueError("a subspace needs a dimension")
    X = PQModel(metric, X[:1], []).prepare(X[np.lexsort(X.T[::-1])])
    centres = lloyd(X, cells)
    rest = X - centres[nearest(X, centres)[0]]
    return PQModel(metric, centres, [lloyd(part, CODES) for part in np.array_split(rest, subspaces, axis=1)])


# ------------------------------------------------------------------ the saved index


@dataclass(frozen=True)
class PQIndex:
    model: PQModel
    rows: DataFrame  # (id, code, vec, cell), partitioned by cell

    def probed(self, cells: np.ndarray) -> DataFrame:
        """Rows of these cells; all others are not read."""
        if len(cells) == len(self.model.centres):
            return self.rows
        return self.rows.where(F.col("cell").isin([int(c) for c in cells]))


def build_pq(corpus: DataFrame, model: PQModel, path: str, id_col: str = "id", vec_col: str = "embedding") -> PQIndex:
    """Write the index of ``corpus`` to ``path`` (a shared folder) and open it. Rows with a
    non-finite element take no part; a null vector or another dimension raises. A cell that holds
    much of the table is written by as many tasks as its size asks for. The model is written
    last: without it there is no index, so a build that broke off is built again."""
    spark = corpus.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            X = arrow_matrix(batch.column(1), m.dim)
            good = np.isfinite(X).all(axis=1)
            batch, X = batch.filter(pa.array(good)), X[good]
            if len(X):
                cell, codes = m.encode(m.prepare(X))
                width = codes.shape[1]
                offsets = pa.py_buffer(np.arange(0, codes.size + 1, width, dtype=np.int32))
                code = pa.Array.from_buffers(pa.binary(), len(X), [None, offsets, pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), code, batch.column(1), pa.array(cell, pa.int32())], names=["id", "code", "vec", "cell"])

    side = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    kind = side.schema["vec"].dataType.simpleString()
    coded = side.mapInArrow(encode, f"id long, code binary, vec {kind}, cell int")
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    parts = [("metric", 0, model.metric, [])] + [("centre", i, None, c.tolist()) for i, c in enumerate(model.centres)]
    parts += [("book", j, None, row.tolist()) for j, book in enumerate(model.books) for row in book]
    numbered = [(n, *p) for n, p in enumerate(parts)]
    spark.createDataFrame(numbered, "n int, kind string, i int, name string, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return open_pq(spark, path)


def open_pq(spark: SparkSession, path: str) -> PQIndex:
    """The index saved at ``path``; an error if there is none."""
    parts = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: r["n"])  # the codebooks
    metric = next(r["name"] for r in parts if r["kind"] == "metric")
    centres = np.array([r["v"] for r in parts if r["kind"] == "centre"])
    count = 1 + max(r["i"] for r in parts if r["kind"] == "book")
    books = [np.array([r["v"] for r in parts if r["kind"] == "book" and r["i"] == j]) for j in range(count)]
    return PQIndex(PQModel(metric, centres, books), spark.read.parquet(f"{path}/rows"))


def has_pq(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/model/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ------------------------------------------------------------------ search


class Nearest:
    """The ``r`` nearest rows so far of every query of a block."""

    def __init__(self, queries: int, r: int):
        self.gap, self.id = np.full((queries, r), np.inf), np.full((queries, r), -1, np.int64)

    def add(self, which: np.ndarray, gap: np.ndarray, ids: np.ndarray) -> None:
        r = self.gap.shape[1]
        if gap.shape[1] > r:
            best = np.argpartition(gap, r - 1, axis=1)[:, :r]
            gap, ids = np.take_along_axis(gap, best, axis=1), ids[best]
        else:
            ids = np.broadcast_to(ids, gap.shape)
        gap, ids = np.concatenate([self.gap[which], gap], axis=1), np.concatenate([self.id[which], ids], axis=1)
        best = np.argpartition(gap, r - 1, axis=1)[:, :r]
        self.gap[which], self.id[which] = np.take_along_axis(gap, best, axis=1), np.take_along_axis(ids, best, axis=1)

    def batch(self, qids: np.ndarray):
        import pyarrow as pa

        q, place = np.nonzero(np.isfinite(self.gap))
        return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(self.id[q, place]), pa.array(self.gap[q, place])], names=["query_id", "id", "gap"])


GAPS = "query_id long, id long, gap double"


def _codes(column) -> np.ndarray:
    """(n, subspaces) codes of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _score_cell(model: PQModel, Q: np.ndarray, which: np.ndarray, cell: int, codes: np.ndarray, ids: np.ndarray, best: Nearest) -> None:
    for at in range(0, len(which), TILE):
        some = which[at : at + TILE]
        best.add(some, model.distances(Q[some], cell, codes), ids)


def _broadcast_gaps(index: PQIndex, block: Block, nprobe: int, rerank: int) -> DataFrame:
    """Candidates of one block: every task keeps the nearest rows of its part of the probed cells."""
    spark, model = index.rows.sparkSession, index.model
    Q = model.prepare(block[1])
    probes = model.probes(Q, nprobe)
    shared = spark.sparkContext.broadcast((model, block[0], Q, probes))

    def score(batches):
        m, qids, asked, probed = shared.value
        owner, flat = np.repeat(np.arange(len(asked)), probed.shape[1]), probed.reshape(-1)
        by = np.argsort(flat, kind="stable")
        owner, flat = owner[by], flat[by]
        best = Nearest(len(asked), rerank)
        for batch in batches:
            cells, ids, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _codes(batch.column(2))
            for cell in np.unique(cells):
                which = owner[slice(*np.searchsorted(flat, (cell, cell + 1)))]
                here = cells == cell
                _score_cell(m, asked, which, int(cell), codes[here], ids[here], best)
        yield best.batch(qids)

    return index.probed(np.unique(probes)).select("cell", "id", "code").mapInArrow(score, GAPS)


class CodeScorer(KeyedScorer):
    """The ``rerank`` coded rows nearest to each query of a block among those of its ``probes``. The
    distance to a decoded row is the sum of the table entries of its codes; as the query's own length
    orders nothing, it is a product of vectors with one more element, -|row|^2 / 2."""

    def __init__(self, model: PQModel, Q: np.ndarray, qids: np.ndarray, nprobe: int, rerank: int):
        P = model.prepare(Q)
        self.model = model
        super().__init__(None, model.probes(P, nprobe).astype(np.int32), rerank, "ip", (qids, np.column_stack([P, np.ones(len(P))])))

    def take(self, cells: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        rows = self.model.decode(cells, codes)
        self.row_keys = lambda X: cells[:, None]
        self.scan(np.column_stack([rows, -0.5 * (rows * rows).sum(axis=1)]), ids)


def _swept_hits(index: PQIndex, queries: DataFrame, n: int, k: int, nprobe: int, rerank: int) -> DataFrame | None:
    """Whole answers, found in the tasks that read the queries; none where there are few of them or
    the vectors take too many blocks (see :func:`search.sweep_of`)."""
    spark, model = queries.sparkSession, index.model
    sweep = sweep_of(index.rows.select("id", "vec"), queries, n, rerank, model.dim)
    if sweep is None:
        return None
    side = index.rows.select("cell", "id", "code")
    count = -(-index.rows.count() * (16 + len(model.books)) // conf_int(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES))
    shared, blocks = spark.sparkContext.broadcast(model), []
    for i in range(max(1, count)):
        table = side.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count))) == i).toArrow()
        if table.num_rows:
            cells, ids = table["cell"].to_numpy().astype(np.int32), table["id"].to_numpy().astype(np.int64)
            blocks.append(spark.sparkContext.broadcast((cells, ids, _codes(table["code"]))))

    def answer(Q, qids):
        found = CodeScorer(shared.value, Q, qids, nprobe, rerank)
        for block in blocks:
            cells, ids, codes = block.value
            for at in range(0, len(ids), VISIT_ROWS):
                some = slice(at, at + VISIT_ROWS)
                found.take(cells[some], ids[some], codes[some])
        q, ids, _ = found.best.rows()
        yield from rescored_answers(Q, qids, [(found.asked[q], ids)], sweep, k, model.metric)

    return swept(queries, sweep, 2 * rerank, answer)


def _grid_gaps(index: PQIndex, queries: DataFrame, nprobe: int, rerank: int) -> DataFrame:
    """Candidates where the queries are too many to broadcast: both sides meet by cell, cells
    with many rows or queries in parts of a bounded size."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index.model)
    kind = queries.schema["query_vec"].dataType.simpleString()

    def probe(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            near = m.probes(m.prepare(arrow_matrix(batch.column(1), m.dim)), nprobe)
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array(near.reshape(-1), pa.int32())], names=["query_id", "query_vec", "cell"])

    asked = queries.mapInArrow(probe, f"query_id long, query_vec {kind}, cell int")
    rows = index.rows.select("id", F.col("code").alias("vec"), "cell")
    q, c = salted_sides(rows, asked, ["cell"], GRID_ROWS, query_rows=4 * TILE)
    q, c = packed(q, c, ["cell"], GRID_ROWS, rows.count())

    def score(left, right):
        import pyarrow as pa

        m = shared.value
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([Nearest(0, 1).batch(np.empty(0, np.int64))])
        Q = m.prepare(arrow_matrix(left.column("query_vec"), m.dim))
        codes, ids = _codes(right.column("vec")), right.column("id").to_numpy()
        cells, asked_cells = right.column("cell").to_numpy(), left.column("cell").to_numpy()
        best = Nearest(len(Q), rerank)
        for cell in np.unique(cells):
            here = cells == cell
            _score_cell(m, Q, np.flatnonzero(asked_cells == cell), int(cell), codes[here], ids[here], best)
        return pa.Table.from_batches([best.batch(left.column("query_id").to_numpy())])

    group = ["_g", "_qs", "_cs"]
    return q.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(score, GAPS)


def _nearest_gaps(gaps: DataFrame, rerank: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("gap", "id")
    return gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rerank)


def pq_topk(index: PQIndex, queries: DataFrame, k: int = 5, *, nprobe: int, rerank: int,
            qid_col: str = "query_id", qvec_col: str = "query_vec") -> DataFrame:
    """Top-k by the index: the ``rerank`` nearest coded rows of the ``nprobe`` nearest cells,
    scored exactly. ``hits[query_id, rank, id, score]`` as :func:`search.exact_topk`."""
    if rerank < k:
        raise ValueError("fewer rows to score again than answers asked for")
    spark = queries.sparkSession
    ship_package(spark)
    nprobe = min(nprobe, len(index.model.centres))
    q = queries.select(F.col(qid_col).cast("long").alias("query_id"), F.col(qvec_col).alias("query_vec"))
    blocks, n, dim = query_blocks(q, conf_int(spark, BROADCAST_BYTES_KEY, DEFAULT_BROADCAST_BYTES), k=rerank)
    if n == 0:
        return no_hits(spark)
    if dim != index.model.dim:
        raise ValueError(f"queries of dimension {dim}, index of {index.model.dim}")
    hits = _swept_hits(index, q, n, k, nprobe, rerank)
    if hits is not None:
        return hits
    if blocks is None:
        gaps = _grid_gaps(index, q, nprobe, rerank)
    else:
        gaps = None
        for block in blocks:
            part = _broadcast_gaps(index, block, nprobe, rerank)
            gaps = part if gaps is None else gaps.unionByName(part)
    cand = _nearest_gaps(gaps, rerank).select("query_id", "id")
    rows = index.rows
    if blocks is not None and len(blocks) == 1:
        rows = index.probed(np.unique(index.model.probes(index.model.prepare(blocks[0][1]), nprobe)))
    bound = n * rerank if n * rerank <= MAX_BROADCAST_HITS else None
    return rescored(cand, rows, q, blocks, k, index.model.metric, "id", "vec", "query_id", "query_vec", bound)


def calibrate_pq(index: PQIndex, k: int = 5, target: float = 0.95, sample: int = CALIBRATION_ROWS) -> tuple[int, int]:
    """(nprobe, rerank) that reach Recall@k of ``target`` for about ``sample`` of the index's own
    vectors, chosen by a hash of the id, against exact search over all rows: the fewest cells
    that hold a share of (1 + target) / 2 of the true neighbours, then the fewest rows to score
    again."""
    model, rows = index.model, index.rows.select("id", "vec", "cell")
    share = min(1.0, sample / max(1, rows.count()))
    own = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(4 * sample)
    asked = own.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    truth = exact_topk(rows, asked, k, model.metric, vec_col="vec").select("query_id", "id")
    located = truth.join(rows.select("id", "cell"), "id").join(asked, "query_id").toArrow()  # sample times k rows
    if not located.num_rows:
        return 1, k
    near = model.probes(model.prepare(arrow_matrix(located["query_vec"], model.dim)), len(model.centres))
    place = np.sort((near == located["cell"].to_numpy()[:, None]).argmax(axis=1))
    nprobe = int(place[min(len(place) - 1, int(np.ceil((1 + target) / 2 * len(place))) - 1)]) + 1

    blocks, _, _ = query_blocks(asked, DEFAULT_BROADCAST_BYTES, always=True)
    most = 64 * k
    found = _nearest_gaps(_broadcast_gaps(index, blocks[0], nprobe, most), most).join(truth, ["query_id", "id"])
    places = np.sort(found.select("place").toArrow()["place"].to_numpy())
    need = int(np.ceil(target * located.num_rows))
    return nprobe, max(k, int(places[need - 1]) if need <= len(places) else most)
