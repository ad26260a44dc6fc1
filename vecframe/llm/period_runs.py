"""Periodic runs of words, by maximal pairs.

Two occurrences of a stretch of l words, q words apart, that agree neither in the word before nor
in the word after, are a maximal pair; if l is at least three times q they overlap, and the l + q
words they span are a run of period q that no neighbour extends. Nothing has to be extended.

Suffixes are sorted within each text by prefix doubling (many texts at once in flat arrays).
The LCP-interval tree is then walked from the bottom up: a node holds its suffixes in order and by
the word left of them, and joining two children of a node yields the pairs of suffixes whose left
words differ. Only pairs at most a third of the node's depth apart are looked for, so suffixes
that have no equal five words that near are left out beforehand.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import small_batches
from vecframe.llm.packing import text_slices
from vecframe.session import ship_package

LEAST_WORDS = 6      # of a run
LEAST_PERIODS = 4    # that a run covers
LEAST_DEPTH = 5      # words that a pair has in common: least run less its period
GROUP_BYTES = 2_000_000
SPACES = "\\x20\\x09-\\x0D"


# --- suffixes ---------------------------------------------------------------------------


def sorted_suffixes(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``key`` and, by k, the rank of each place by its first 2^k symbols
    (equal for equal symbols only). Every text ends in a symbol of its own, and symbols of
    different texts differ, so a repeated stretch lies within one text."""
    order = np.argsort(key, kind="stable").astype(np.int64)
    slots = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int32)
    levels, width = [], 1
    while True:
        places = order[slots]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.copy())
        again = ~new  # of a group with more than one member
        again[:-1] |= ~new[1:]
        slots, places = slots[again], places[again]
        if not len(slots):
            return order, levels
        pair = rank[places].astype(np.int64) * len(key) + rank[places + width]
        by = np.argsort(pair, kind="stable")
        order[slots], pair = places[by], pair[by]
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        width *= 2


def common_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` have in common."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        found += (levels[k][a + found] == levels[k][b + found]).astype(np.int64) << k
    return found


def near_suffixes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order that can be in a pair, and what each has in common with the next."""
    order, levels = sorted_suffixes(key)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(levels) < 3:  # no four words repeat
        return none
    four = levels[2][order]
    depth = np.zeros(len(order) + 1, np.int64)  # with the suffix before; then a last zero
    at = np.flatnonzero(four[1:] == four[:-1]) + 1
    depth[at] = common_words(order[at - 1], order[at], levels)
    del levels
    depth[depth < LEAST_DEPTH] = 0
    deepest = np.maximum(depth[:-1], depth[1:])
    some = np.flatnonzero(deepest)
    if not len(some):
        return none
    group = np.cumsum(depth[:-1] == 0)[some]  # of equal five words
    by = np.lexsort((order[some], group))
    gap = np.diff(order[some][by]).astype(np.float64)
    gap[np.diff(group[by]) != 0] = np.inf
    nearest = np.empty(len(some))
    nearest[by] = np.minimum(np.append(np.inf, gap), np.append(gap, np.inf))
    kept = some[3 * nearest <= deepest[some]]
    if not len(kept):
        return none
    with_next = np.append(np.minimum.reduceat(depth[: kept[-1] + 1], kept[:-1] + 1) if len(kept) > 1 else none[0], 0)
    return order[kept], with_next


# --- maximal pairs ----------------------------------------------------------------------


class Node:
    """Suffixes of an interval, in order, and by the word left of them."""

    __slots__ = ("places", "by_left")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.by_left = {left: [place]}


def _merge(into: list[int], more: list[int]) -> None:
    if len(more) * 8 < len(into):
        for x in more:
            insort(into, x)
    else:
        into += more
        into.sort()  # two ordered stretches: linear


def join(a: Node, b: Node, depth: int, left: np.ndarray, pairs: list[tuple[int, int, int]]) -> Node:
    """One node of two children, whose pairs at a distance of up to depth / 3 and with different
    left words are added to ``pairs`` as (start, distance, depth)."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach, places = depth // 3, a.places
    for word, mine in b.by_left.items():
        same = a.by_left.get(word, ())
        for i in mine:
            first, last = bisect_left(places, i - reach), bisect_right(places, i + reach)
            if first == last:
                continue
            if same and last - first == bisect_right(same, i + reach) - bisect_left(same, i - reach):
                continue
            if len(a.by_left) < last - first:
                near = [x for w, xs in a.by_left.items() if w != word for x in xs[bisect_left(xs, i - reach) : bisect_right(xs, i + reach)]]
            else:
                near = [x for x in places[first:last] if left[x] != word]
            pairs += [(min(i, x), abs(i - x), depth) for x in near]
    _merge(places, b.places)
    for word, mine in b.by_left.items():
        if word in a.by_left:
            _merge(a.by_left[word], mine)
        else:
            a.by_left[word] = mine
    return a


def maximal_pairs(suffixes: np.ndarray, with_next: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows (start, distance, common words) of the maximal pairs near enough to overlap."""
    pairs: list[tuple[int, int, int]] = []
    open_nodes: list[tuple[int, Node]] = []  # intervals around the current suffix, by depth
    words = left[suffixes].tolist()
    for place, word, depth in zip(suffixes.tolist(), words, with_next.tolist(), strict=True):
        node = Node(place, word)
        while open_nodes and open_nodes[-1][0] > depth:
            inner, done = open_nodes.pop()
            node = join(done, node, inner, left, pairs)
        if open_nodes and open_nodes[-1][0] == depth:
            open_nodes[-1] = depth, join(open_nodes[-1][1], node, depth, left, pairs)
        elif depth:
            open_nodes.append((depth, node))
    return np.array(pairs, np.int64).reshape(-1, 3)


def runs(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, period, length) of all runs, by start and then period. ``words`` are numbers
    of words, ``text`` (not falling) the text each is of; starts count over all texts."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    texts, size = int(text[-1]) + 1, int(words.max()) + 2
    place = np.arange(len(words)) + text  # one closing symbol after each text
    key = np.full(len(words) + texts, size - 1, np.int64)
    key[place] = words
    owner = np.repeat(np.arange(texts), np.bincount(text, minlength=texts) + 1)
    left = np.append(-1, key[:-1])
    left[1:][owner[1:] != owner[:-1]] = -1
    found = maximal_pairs(*near_suffixes(owner * size + key), left)
    start, period = found[:, 0], found[:, 1]
    length = found[:, 2] + period
    # the same stretch is also a pair at multiples of its smallest period
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    smallest = np.ones(len(by), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start - owner[start], period, length], axis=1)[smallest]
    rows = rows[(rows[:, 2] >= LEAST_WORDS) & (rows[:, 2] >= LEAST_PERIODS * rows[:, 1])]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


# --- documents --------------------------------------------------------------------------

RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed string"


def _structs(start: np.ndarray, length: np.ndarray, period: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"], mask=None if mask is None else pa.array(mask))


def _runs_of_texts(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    flat, text = flat.filter(there), text[there.to_numpy(zero_copy_only=False)]
    found = runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), text)
    begins = np.searchsorted(text, np.arange(len(texts) + 1))

    start, period, length = found.T
    drop = np.zeros(len(flat) + 1, np.int64)  # every word of a run after its first period
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    bounds = np.append(0, np.cumsum(keep))[begins]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat.filter(pa.array(keep))), " ")

    owner = text[start]
    own = start - begins[owner]
    run_bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    # exact: quotients of numbers below 2^26 that differ differ as doubles
    best = np.lexsort((period, start, -(length / period), owner))
    first = np.minimum(run_bounds[:-1], max(len(best) - 1, 0))
    chosen = best[first] if len(best) else np.zeros(len(texts), np.int64)
    none = run_bounds[1:] == run_bounds[:-1]
    pick = lambda x: x[chosen] if len(x) else np.zeros(len(texts), np.int64)
    return pa.RecordBatch.from_arrays(
        [keys, pa.ListArray.from_arrays(pa.array(run_bounds), _structs(own, length, period)), _structs(pick(own), pick(length), pick(period), none), collapsed],
        names=["doc_id", "runs", "strongest", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, runs, strongest, collapsed)``, one row per row of ``docs``: all runs (start and
    length in words, smallest period) of at least six words and four periods, by start and then
    period; the run of the greatest length / period (ties: smallest start, then period; null where
    there is none); and the text, words joined by one space, without the words that a run
    repeats, that is, all but the first period of each run.

    A null or empty text has no runs and collapses to an empty one. Repeated rows and null ids
    are rows like any other; further columns are ignored; an empty table gives an empty table.
    A text is handled whole, however long, in one task; nothing is shuffled."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in text_slices(batch.column(1), GROUP_BYTES):
                part = batch.slice(first, rows)
                yield _runs_of_texts(part.column(0), part.column(1))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def plant_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the contract's planted repeats: where h, the CRC-32 of the decimal
    id, is a multiple of ten, the words from a on repeat the p words from a on, with
    g = h div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id or a text without
    words is left as it is."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.array_remove(F.split("text", f"[{SPACES}]+"), ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"words": words, "g": F.expr("crc32(cast(doc_id as string)) div 10")})
    rows = rows.withColumns({"n": F.when(F.size("words") > 0, F.size("words"))})
    rows = rows.withColumns({"a": F.expr("cast(g % n as int)")})
    rows = rows.withColumns({"p": F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")})
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    planted = F.expr(f"array_join(concat(slice(words, 1, a), {tail}), ' ')")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, its repeats planted first."""
    found = periodic_runs(plant_periods(docs))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
