"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The distinct pieces of many texts lie in one flat array of symbols. A round looks up all
neighbouring pairs by binary search over the sorted pair keys, finds the lowest rank in each
word, and merges every occurrence of that pair in the word, left to right, until no word has
a pair left. Texts are put together from their pieces' ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import small_batches
from vecframe.session import ship_package

# Fixed value: the pattern that splits text before the merges (byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 250_000   # distinct pieces that a worker remembers; beyond it starts anew
BATCH_CHARS = 2_000_000  # characters of text whose new pieces are merged in one go
MERGE_BYTES = 4_000_000  # symbols in one flat array, unless a single piece is longer
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for the 256 bytes: printable Latin-1 stands
    for itself, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.split = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            open_words = np.repeat(low < NO_RANK, length)
            if not open_words.all():  # words without a pair are finished
                done_ids.append(ids[~open_words])
                done_word.append(word[~open_words])
            hit = np.flatnonzero((rank == np.repeat(low, length)) & open_words)
            if not len(hit):
                break
            # in a run of touching hits (aaa) every second one counts
            new_run = np.append(True, np.diff(hit) > 1)
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            ids = ids.copy()
            ids[hit] = self.made[at[hit]]
            keep = open_words
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(pieces))) * 4
        return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Ids of new pieces into the cache, in arrays of bounded length."""
        group, size = [], 0
        for piece in chain(pieces, [None]):
            if piece is None or size > MERGE_BYTES:
                self.cache.update(zip(group, self.merge([p.encode("utf-8", "replace") for p in group]), strict=True))
                group, size = [], 0
            if piece is not None:
                group.append(piece)
                size += len(piece)

    def _cut(self, text: str) -> list[tuple[str, list[str]]]:
        """Special tokens and the pieces of what lies between them."""
        if self.parts is None or not any(t in text for t in self.special):
            return [("", self.split(text))]
        return [(p, []) if p in self.special else ("", self.split(p)) for p in self.parts(text) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        new = set()
        for text in cut:
            for _, pieces in text:
                new.update(pieces)
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        self.learn(new.difference(self.cache))
        get = self.cache.__getitem__
        return [
            b"".join(self.special[s].to_bytes(4, "little") if s else b"".join(map(get, pieces)) for s, pieces in text)
            for text in cut
        ]

    def decode(self, ids: bytes) -> str:
        """Text of ids: their bytes together, malformed ones replaced."""
        get = self.token.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def text_groups(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together; one longer text alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: whole texts as ids, little-endian unsigned 32-bit integers in one
    binary. Null counts as empty and gives no ids; special tokens' strings are encoded as
    those tokens. One row per row; further columns are ignored; ``path`` must be readable by
    every worker."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for group in text_groups(t.as_py() or "" for t in batch.column(1)):
                ids = bpe.encode(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at += len(ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text)``: ids as of :func:`encode_documents` to their text; null ids
    count as none."""
    ship_package(encoded.sparkSession)
    small_batches(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text = pa.array([bpe.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, text string")


def digest_documents(docs: DataFrame, path: str, **columns) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text's encoding and of
    the text decoded from it."""
    whole = decode_documents(encode_documents(docs, path, **columns), path)
    return whole.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )
