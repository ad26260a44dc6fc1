"""Toxic passages as maximum-scoring segments over token log-odds.

Tokens get the log-odds of toxic against clean training texts under an informative Dirichlet
prior (the prior mass lies on tokens as often as in all training texts), taken at the cautious
end of a confidence interval, so that rarely seen tokens stay neutral. A linear scan finds all
maximal-scoring segments of a text. The chance that clean text reaches a segment's score
follows an extreme-value law whose two parameters are fitted to the best segments of clean
training texts; the evidence of all a text's segments is added up and mapped to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import small_batches
from vecframe.llm.row_keys import keyed
from vecframe.session import cut_lineage, ship_package

FOLDS = 5                 # rows with crc32(id) mod FOLDS = 0 are held out
TRAIN_ROWS = 200_000      # about so many labelled rows are learned from, chosen by a hash of the id
PREFIXES = (8, 7, 6, 5, 4, 3)  # a word that isn't known counts as its longest known beginning
PRIOR_SHARE = 0.01        # mass of the prior, in shares of all training tokens
CONFIDENCE = 2.33         # standard errors that a log-odds is drawn towards zero
LEAST_SHARE = 5e-7        # of all training tokens; so the model has at most 2 million entries
LEAST_TEXTS = 3
DRIFT = 0.05              # what a token costs, so that a text's expected score is negative
SIGNIFICANT = 0.05        # expected number of equal segments in clean text of this length
COUNTED_WORDS = 150_000   # distinct tokens a task counts before it passes them on
CACHE_WORDS = 250_000     # words whose score a worker remembers; beyond it starts anew

_WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> tuple[str, ...]:
    """The word, and its beginnings (marked) from the longest to the shortest."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


# --- learning ---------------------------------------------------------------------------


def in_holdout(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` of the texts learned from, each distinct text once: labelled, not
    held out. About TRAIN_ROWS rows, so it may be broadcast. A text with several labels has
    the commoner one, toxic if they tie."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_holdout("doc_id"))
    seen = seen.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).alias("toxic"))
    share = min(1.0, TRAIN_ROWS / max(1, seen.count()))
    if share < 1.0:
        seen = seen.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(F.broadcast(seen), "doc_id")
    texts = texts.select("doc_id", "toxic", F.xxhash64("text").alias("h"))
    one = texts.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic"))
    return cut_lineage(one.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        clean, toxic = found
        names = list(clean.keys() | toxic.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())],
            names=["form", "toxic", "clean"],
        )
        clean.clear()
        toxic.clear()
        return out

    for batch in batches:
        for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            found[bool(toxic.as_py())].update({f for w in words for f in forms(w)})
            if len(found[0]) + len(found[1]) > COUNTED_WORDS:
                yield flush()
    yield flush()


def token_scores(docs: DataFrame, train: DataFrame) -> dict[str, float]:
    """Score of every token form that differs between the classes beyond doubt, and zero for
    those well known that a beginning would otherwise speak for."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.join(F.broadcast(train), "doc_id").select("toxic", "text")
    counts = cut_lineage(
        texts.mapInArrow(_count, "form string, toxic long, clean long").groupBy("form")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    nt, nc = int(total["t"] or 0), int(total["c"] or 0)
    if not nt or not nc:
        return {}
    least, mass = max(LEAST_TEXTS, LEAST_SHARE * (nt + nc)), PRIOR_SHARE * (nt + nc)
    prior = (F.col("toxic") + F.col("clean")) / (nt + nc) * mass
    odds = lambda c, n: F.log((F.col(c) + prior) / (n + mass - F.col(c) - prior))
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)) * CONFIDENCE
    known = counts.where(F.col("toxic") + F.col("clean") >= least).select(
        "form", (odds("toxic", nt) - odds("clean", nc)).alias("d"), error.alias("e")
    )
    score = F.when(F.col("d") > F.col("e"), F.col("d") - F.col("e")).when(-F.col("d") > F.col("e"), F.col("d") + F.col("e")).otherwise(0.0)
    known = known.withColumn("s", score)
    table = {r["form"]: r["s"] for r in known.where("s <> 0").select("form", "s").collect()}  # bounded by LEAST_SHARE
    starts = [(f, s) for f, s in table.items() if s > 0 and f.endswith("*")]
    if starts:  # a form whose own counts contradict a toxic beginning is neutral
        marked = docs.sparkSession.createDataFrame(starts, "start string, least double")
        neutral = known.where("s = 0").select("form", "d", "e", F.explode(F.array(*[F.concat(F.substring("form", 1, n), F.lit("*")) for n in PREFIXES])).alias("start"))
        table |= {r["form"]: 0.0 for r in neutral.join(F.broadcast(marked), "start").where("d + e < least").select("form").distinct().collect()}
    return table


# --- segments ---------------------------------------------------------------------------


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a text in which the tokens at ``places`` have
    ``scores`` and every token costs ``drift``: (first token, last token, score). Each
    candidate keeps its cumulative sums left and right of it and the nearest candidate with
    a smaller left sum, so the scan is linear in the number of places."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, left sum, right sum, link
    total, before = 0.0, 0
    for at, s in zip(places, scores, strict=True):
        left = total - drift * (at - before)
        total, before = left + s - drift, at + 1
        if s <= drift:
            continue
        first, low, high = at, left, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((first, at, low, high, j))
                break
            first, low, back = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = back
    return [(a, b, h - l) for a, b, l, h, _ in found]


class _Scores(dict):
    """Score of a word: its own, or else that of its longest known beginning."""

    def __init__(self, table: dict[str, float]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = next((self.table[f] for f in forms(word) if f in self.table), 0.0)
        self[word] = value
        return value


SEGMENTS = "array<struct<start: int, end: int, score: double>>"


def text_segments(docs: DataFrame, table: dict[str, float], carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, segments)``; starts and ends count characters, ends exclusive.
    The long columns named by ``carry`` come last."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            sizes, lists = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                low = text.lower()
                words = _WORD.findall(low)
                own = list(map(scores.__getitem__, words))
                sizes.append(len(own))
                if not own or max(own) <= DRIFT:
                    lists.append([])
                    continue
                places = [i for i, s in enumerate(own) if s]
                segments = maximal_segments(places, [own[i] for i in places])
                ends = [m.span() for m in _WORD.finditer(low)]
                lists.append([{"start": ends[a][0], "end": ends[b][1], "score": s} for a, b, s in segments])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, kind), *batch.columns[2:]],
                names=["doc_id", "n_tokens", "segments", *carry],
            )

    schema = ", ".join([f"doc_id long, n_tokens long, segments {SEGMENTS}", *[f"{c} long" for c in carry]])
    return docs.select("doc_id", "text", *carry).mapInArrow(work, schema)


# --- calibration ------------------------------------------------------------------------


def extreme_value_fit(cells: list[tuple[float, float, int]]) -> tuple[float, float]:
    """``(decay, scale)`` so that clean text of n tokens reaches score x about
    ``scale * n * exp(-decay * x)`` times: most likely values for best scores given as
    (tokens, best score, texts), a best score of zero meaning none was reached."""
    n = np.array([c[0] for c in cells], float)
    x = np.array([c[1] for c in cells], float)
    m = np.array([c[2] for c in cells], float)
    hit = x > 0
    hits, length = float(m[hit].sum()), float((n * m).sum())
    if not hits or not length:
        return 1.0, 0.5 / max(1.0, length)
    best = max(
        (hits * math.log(d * hits / float((n * m * np.exp(-d * x)).sum())) - d * float((x * m)[hit].sum()), d)
        for d in np.geomspace(0.05, 10, 120)
    )[1]
    return float(best), hits / float((n * m * np.exp(-best * x)).sum())


def logistic_fit(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope (never negative) for (evidence, label, texts)."""
    x = np.array([c[0] for c in cells], float)
    y = np.array([c[1] for c in cells], float)
    m = np.array([c[2] for c in cells], float)
    base = (float((m * y).sum()) + 0.5) / (float(m.sum()) + 1.0)
    if not len(cells) or x.min() == x.max() or y.min() == y.max():
        return math.log(base / (1 - base)), 0.0
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    w[0] = math.log(base / (1 - base))
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (m * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, design.T @ (m * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_tokens, segments)``, one row per row of
    ``docs``. score in 0..1 is higher the likelier the label 1; predicted is 1 from 0.5 on;
    segments are the significant toxic passages (start, end, score, evalue).

    Learned are labels of rows that are not held out (``crc32`` of the id's text mod 5 is not
    0) only; nothing but the text is an input of a score. Null and empty texts have no
    tokens and the score of a text without evidence; a null id is never learned from; null
    labels are ignored; repeated texts are learned from once; without any labels, or with
    one class only, all scores are the share of toxic ones. Further columns are ignored. An
    empty table gives an empty table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scores(rows, labels, id_col, label_col)


def _scores(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The scores of ``rows(doc_id, text)``, with the long columns named by ``carry``."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    train = _training_rows(rows, known)
    found = cut_lineage(text_segments(rows, token_scores(rows, train), carry))

    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    learned = found.join(F.broadcast(train), "doc_id").where("n_tokens > 0")
    cells = (
        learned.where("not toxic").groupBy(F.floor(F.log2("n_tokens") * 2).alias("n"), (F.ceil(best * 4) / 4).alias("x"))
        .agg(F.count("*").alias("m")).collect()
    )  # a few dozen lengths by a few hundred scores
    decay, scale = extreme_value_fit([(2 ** ((r["n"] + 0.5) / 2), float(r["x"]), r["m"]) for r in cells])

    expected = lambda s: scale * F.col("n_tokens") * F.exp(-decay * s["score"])
    evidence = F.aggregate(
        F.transform("segments", expected), F.lit(0.0),
        lambda a, e: a + F.when(e < 1, -F.log(e)).otherwise(0.0),
    )
    scored = found.withColumn("x", F.least(evidence, F.lit(200.0)))
    cells = (
        scored.join(F.broadcast(train), "doc_id").where("n_tokens > 0")
        .groupBy((F.round(F.col("x") * 4) / 4).alias("x"), F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("m")).collect()
    )  # at most 801 by 2
    start, slope = logistic_fit([(float(r["x"]), r["y"], r["m"]) for r in cells])
    score = 1 / (1 + F.exp(-(F.lit(start) + F.lit(slope) * F.col("x"))))
    passages = F.filter(
        F.transform("segments", lambda s: s.withField("evalue", expected(s))), lambda s: s["evalue"] <= SIGNIFICANT
    )
    return scored.select(
        "doc_id", in_holdout("doc_id").alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), "n_tokens", passages.alias("segments"), *carry,
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, whatever their ids; all columns as they are.
    Every row goes or stays by its own text, also if others have its id."""
    every, key = keyed(docs)
    rows = every.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(key[0]).alias("high"), F.col(key[1]).alias("low"),
    )
    toxic = _scores(rows, labels, id_col, "toxic", ("high", "low")).where("predicted = 1")
    gone = toxic.select(F.col("high").alias(key[0]), F.col("low").alias(key[1])).distinct()
    return every.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
