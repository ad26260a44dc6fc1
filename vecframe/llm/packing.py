"""Packing of token sequences as vector bin packing with the dot-product heuristic.

An example has a demand in three dimensions: tokens, segments (one) and loss-bearing tokens.
Into the open sequence goes, of the waiting examples that fit in all three, the one whose
demand has the largest dot product with what is left, both measured in shares of the limits.
If none fits whole, the longest waiting example is cut at what is left. A task packs the
rows of its partition as they come with a bounded number of waiting examples, so nothing is
shuffled, and a task that is run again makes the same sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import light_batches, small_batches
from vecframe.session import ship_package

MAX_TOKENS = 2048
MAX_SEGMENTS = 512
MAX_LOSS_TOKENS = 2048
WAITING = 512            # examples from which the next one is chosen
END_ID = 1               # closes every document
CACHE_WORDS = 200_000    # distinct words of a generation that a worker remembers
GROUP_CHARS = 3_000_000  # bytes of text whose words are numbered in one go


# --- token ids --------------------------------------------------------------------------


class WordIds:
    """Ids by the tokenizers library, asked once per distinct word.

    The vocabulary drops white space and joins nothing across it, so a text's ids are its
    words' ids in order. The words of many texts are numbered by Arrow; plain words (Latin
    letters, then at most one full stop or comma) are asked for by their letters, many at a
    time, and told apart by the end-of-word tokens; all others are asked for as they are."""

    PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ask_plain(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                out += self._ask(part)
                continue
            flat = ids.tobytes()
            out += [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _ids(self, words: list[str], ask) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:  # the last generation is still looked up
            self.last, self.known = self.known, {}
        new = []
        for word in words:
            if word not in self.known:
                if (ids := self.last.get(word)) is None:
                    new.append(word)
                else:
                    self.known[word] = ids
        self.known.update(zip(new, ask(new), strict=True))
        return [self.known[w] for w in words]

    def encode(self, texts: pa.Array, last: bytes = b"") -> pa.Array:
        """Ids of each text and ``last``: a binary of little-endian unsigned 32-bit integers."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary
        marked = pc.match_substring_regex(distinct, "[.,]$")
        core = pc.if_else(marked, pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        plain = pc.match_substring_regex(core, self.PLAIN)
        letters = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        other = distinct.filter(pc.invert(plain)).to_pylist()
        # units: the marks, the distinct plain letters, the other words, the closing ids
        units = self._ids([".", ","], self._ask)
        units += self._ids(letters.dictionary.to_pylist(), self._ask_plain)
        units += [*self._ids(other, self._ask), last]
        is_plain = plain.to_numpy(zero_copy_only=False)
        unit = np.empty(len(distinct), np.int64)
        unit[is_plain] = 2 + letters.indices.to_numpy()
        unit[~is_plain] = 2 + len(letters.dictionary) + np.arange(len(other))
        mark = np.full(len(distinct), -1)
        with_mark = is_plain & marked.to_numpy(zero_copy_only=False)
        mark[with_mark] = pc.ends_with(distinct, ",").to_numpy(zero_copy_only=False)[with_mark]

        at = numbered.indices.to_numpy()
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        own, follow = unit[at], mark[at]
        shift = np.cumsum(follow >= 0)  # marks so far, the word's own included
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        sequence = np.empty(len(at) + (int(shift[-1]) if len(at) else 0) + len(texts), np.int64)
        place = np.arange(len(at)) + shift - (follow >= 0) + row
        sequence[place] = own
        sequence[place[follow >= 0] + 1] = follow[follow >= 0]
        before = np.concatenate(([0], shift))[bounds[1:]]
        closing = bounds[1:] + before + np.arange(len(texts))
        sequence[closing] = len(units) - 1

        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        pool, starts = np.frombuffer(b"".join(units), "<u4"), np.cumsum(sizes) - sizes
        length = sizes[sequence]
        ends = np.cumsum(length)
        flat = pool[np.repeat(starts[sequence] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate(([0], ends[closing])) * 4
        kind = pa.binary() if cuts[-1] < 2**31 else pa.large_binary()
        offsets = cuts.astype(np.int32 if kind == pa.binary() else np.int64)
        return pa.Array.from_buffers(kind, len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4"))])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def text_slices(texts: pa.Array, chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive texts of about ``chars`` bytes; a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > chars:
            yield first, i - first
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes) - first


def document_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(doc_id, ids)``: the whole text's ids and ``end_id``, as one binary of little-endian
    unsigned 32-bit integers; a null or empty text has the last id only. ``path`` is a
    vocabulary file with word ends, readable by every worker."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    last = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            for first, rows in text_slices(batch.column(1)):
                part = batch.slice(first, rows)
                made = ids.encode(pc.fill_null(part.column(1), ""), last)
                yield pa.RecordBatch.from_arrays([part.column(0), made.cast(pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids binary")


# --- packing ----------------------------------------------------------------------------


@dataclass
class Example:
    """What is still to be placed of an example: ids from ``start`` on, of ``total``."""

    key: object
    start: int
    total: int
    ids: np.ndarray
    loss: np.ndarray | None = None  # per id whether it bears loss; none: all do

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """How many ids fit into so many tokens and loss-bearing tokens."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        return int(np.searchsorted(np.cumsum(self.loss[:tokens]), loss, side="right"))

    def cut(self, n: int) -> tuple[Example, Example]:
        head, tail = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return (Example(self.key, self.start, self.total, self.ids[:n], head),
                Example(self.key, self.start + n, self.total, self.ids[n:], tail))


class Packer:
    """Yields complete sequences, each a list of pieces."""

    def __init__(self, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS)):
        if min(limits) < 1:
            raise ValueError("every limit must be at least one")
        self.limits = limits
        self.full = np.array(limits, np.float64)
        self.waiting: list[Example | None] = [None] * WAITING
        self.share = np.full((WAITING, 3), np.inf)  # demands; infinite where no example waits
        self.empty = list(range(WAITING))

    def _wait(self, example: Example) -> None:
        at = self.empty.pop()
        self.waiting[at], self.share[at] = example, example.demand()

    def _take(self, at: int) -> Example:
        example, self.waiting[at], self.share[at] = self.waiting[at], None, np.inf
        self.empty.append(at)
        return example

    def add(self, example: Example) -> Iterator[list[Example]]:
        tokens, _, loss = self.limits
        while len(example.ids) >= tokens or example.demand()[2] > loss:  # more than fits: full sequences of its own
            piece, example = example.cut(example.fitting(tokens, loss))
            yield [piece]
        if len(example.ids):
            self._wait(example)
        if not self.empty:
            yield self.fill()

    def finish(self) -> Iterator[list[Example]]:
        while len(self.empty) < WAITING:
            yield self.fill()

    def fill(self) -> list[Example]:
        """One sequence from the waiting examples."""
        left, placed = self.full.copy(), []
        while left[0] >= 1 and left[1] >= 1 and len(self.empty) < WAITING:
            fits = np.flatnonzero((self.share <= left).all(axis=1))
            if len(fits):
                pick = int(fits[(self.share[fits] @ (left / self.full**2)).argmax()])
                left -= self.share[pick]
                placed.append(self._take(pick))
                continue
            pick = int(np.where(np.isfinite(self.share[:, 0]), self.share[:, 0], -1.0).argmax())
            n = self.waiting[pick].fitting(int(left[0]), int(left[2]))
            if n:
                piece, back = self._take(pick).cut(n)
                placed.append(piece)
                self._wait(back)
            break
        return placed


def powers_of_two(sequence: list[Example]) -> Iterator[list[Example]]:
    """An unfilled sequence laid out anew in sequences whose lengths are powers of two, which
    need no padding."""
    length = sum(len(p.ids) for p in sequence)
    rest = list(sequence)
    while length:
        room = 1 << (length.bit_length() - 1)
        length -= room
        part = []
        while room:
            piece = rest.pop(0)
            if len(piece.ids) > room:
                piece, back = piece.cut(room)
                rest.insert(0, back)
            part.append(piece)
            room -= len(piece.ids)
        yield part


PIECES = "doc_id long, start long, length long, n_loss long, ids binary, doc_tokens long, sequence_id long, offset long, segment int"
Limits = tuple[int, int, int]


def _packed(examples: Iterator[Example], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Pieces of one task's examples, in batches of about 2,000."""
    packer, number = Packer(limits), TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def emit(sequence: list[Example]) -> None:
        nonlocal number
        offset = 0
        for i, p in enumerate(sequence):
            rows.append((p.key, p.start, len(p.ids), p.demand()[2], p.ids.tobytes(), p.total, number, offset, i))
            offset += len(p.ids)
        number += 1

    for example in examples:
        for sequence in packer.add(example):
            emit(sequence)
        if len(rows) >= 2000:
            yield flush()
    for sequence in packer.finish():
        if len(packer.empty) < WAITING or sum(len(p.ids) for p in sequence) == limits[0]:
            emit(sequence)
        else:
            for part in powers_of_two(sequence):
                emit(part)
    if rows:
        yield flush()


def pack(examples: DataFrame, limits: Limits = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS)) -> DataFrame:
    """``examples(doc_id, ids[, loss])`` to pieces ``(doc_id, start, length, n_loss, ids,
    doc_tokens, sequence_id, offset, segment)``.

    ids: little-endian unsigned 32-bit integers; loss: one byte per id, zero where it bears
    no loss (null or absent: every id does). Each id lies in exactly one piece; pieces lie
    gapless in their sequence, which keeps within ``limits`` (tokens, segments, loss-bearing
    tokens). Sequences are full but where a segment or loss limit is reached first; the last
    one of a task goes into sequences of power-of-two lengths. Null or empty ids make no
    piece; rows with equal or null ids are examples of their own; an empty table makes none.
    ``sequence_id`` is the task's partition times 2^32 and a running number."""
    ship_package(examples.sparkSession)
    small_batches(examples.sparkSession)
    masked = "loss" in examples.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for batch in batches:
            losses = batch.column(2) if masked else [None] * batch.num_rows
            for key, ids, loss in zip(batch.column(0), batch.column(1), losses, strict=True):
                ids = np.frombuffer(ids.as_py() or b"", "<u4")
                loss = None if loss is None or loss.as_py() is None else np.frombuffer(loss.as_py(), np.uint8) != 0
                yield Example(key.as_py(), 0, len(ids), ids, loss)

    cols = ["doc_id", "ids", *(["loss"] if masked else [])]
    return examples.select(*cols).mapInArrow(lambda batches: _packed(read(batches), limits), PIECES)


def pack_documents(
    docs: DataFrame, path: str, limits: Limits = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS),
    id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """What :func:`pack` makes of :func:`document_ids`, numbered and packed by one worker of a
    task, which holds the ids of one slice of texts and of the waiting examples at a time."""
    ship_package(docs.sparkSession)
    light_batches(docs.sparkSession)
    last = int(end_id).to_bytes(4, "little")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        model = word_ids(path)
        for batch in batches:
            for first, rows in text_slices(batch.column(1)):
                keys = batch.column(0).slice(first, rows).to_pylist()
                made = model.encode(pc.fill_null(batch.column(1).slice(first, rows), ""), last)
                for key, ids in zip(keys, made, strict=True):
                    ids = np.frombuffer(ids.as_py(), "<u4")
                    yield Example(key, 0, len(ids), ids)
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _packed(read(batches), limits), PIECES)
