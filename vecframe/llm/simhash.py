"""SimHash near-duplicates through Golay-code fuzzy hashing.

The 64-bit fingerprint is cut into three segments of at most 23 bits. If two fingerprints
differ in at most four bits, at least two of the three segments differ in at most two bits
each (three errors in two segments would make six). The binary Golay code (23, 12) is
perfect: each 23-bit word has exactly one codeword within three bits. A segment's keys are
the codeword indices of all words within one bit of it (mostly six of them); two segments
that differ in at most two bits have a word within one bit of both, so they share a key.
Fingerprints that share the keys of two segments meet, and their bit distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import small_batches
from vecframe.llm.components import connected_components
from vecframe.llm.row_keys import keyed
from vecframe.session import cut_lineage, ship_package

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GOLAY_POLYNOMIAL = 0xAE3  # generator of the binary Golay code (23, 12)
BLOCK = 4096  # fingerprints of one key compared in one go; larger keys go by pairs of blocks


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the hashes of all word shingles; zero for a text without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z; ASCII white space
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _text_prints(rows, words)


def _text_prints(rows: DataFrame, words: int) -> DataFrame:
    """``rows``, whose last column is a text and all others longs, with fp instead of the text."""
    ship_package(rows.sparkSession)
    small_batches(rows.sparkSession)
    names = [*rows.columns[:-1], "fp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*others, pa.array(prints.view(np.int64))], names=names)

    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


# --- Golay keys -----------------------------------------------------------------------


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the upper twelve bits by the generator, and the error pattern of at most
    three bits that each of the 2048 remainders stands for."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word

    upper = np.array([remainder(i << 11) for i in range(4096)], np.int32)
    single = [remainder(1 << b) for b in range(23)]
    errors = np.zeros(2048, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            left = 0
            for b in bits:
                left ^= single[b]
            errors[left] = sum(1 << b for b in bits)
    return upper, errors


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (upper twelve bits) of the codeword nearest to each 23-bit word."""
    upper, errors = tables
    return (words ^ errors[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_keys(prints: np.ndarray, segment: tuple[int, int], tables) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint the sorted codeword indices within one bit of the segment, and which
    of them are the first of their kind."""
    first, width = segment
    word = ((prints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int32)
    flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int32))).astype(np.int32)
    keys = np.sort(golay_index(word[:, None] ^ flips[None, :], tables), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, fresh


def print_keys(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` arrays: every key of every pair of segments."""
    found = [segment_keys(prints, s, tables) for s in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (ka, fa), (kb, fb) = found[i], found[j]
        row, x, y = np.nonzero(fa[:, :, None] & fb[:, None, :])
        rows.append(row)
        keys.append((pair << 24) | (ka[row, x] << 12) | kb[row, y])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


# --- links ----------------------------------------------------------------------------


def spanning_links(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect just what all pairs within ``max_bits`` connect: a breadth-first
    walk, so at most one link per fingerprint instead of every pair."""
    rest, links = prints, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                new = rest[near]
                links += [(int(at), int(x)) for x in new]
                queue.extend(new)
                rest = rest[~near]
    return links


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _bucket_links(keys: np.ndarray, prints: np.ndarray, max_bits: int):
    """Links of sorted complete buckets: small ones by shifted comparison of the whole
    array, larger ones by a walk; buckets beyond BLOCK are returned as (key, prints)."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    links, hot = [], []
    small = np.repeat(sizes <= 16, sizes)
    k, p = keys[small], prints[small]
    for shift in range(1, 16):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        same = same[np.bitwise_count(p[same] ^ p[same + shift]) <= max_bits]
        links.append(np.stack([p[same], p[same + shift]], axis=1))
    for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        if n <= BLOCK:
            if found := spanning_links(prints[s : s + n], max_bits):
                links.append(np.array(found, np.uint64))
        else:
            hot.append((int(keys[s]), prints[s : s + n]))
    return (np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 2), np.uint64)), hot


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 2000):
            part = prints[at : at + 2000]
            rows, keys = print_keys(part, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


LINK_ROWS = "a long, b long, key int, block int, prints binary"


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints(fp)``, each once, to links ``(a, b)`` whose components are those of all pairs
    within ``max_bits``. Buckets of up to BLOCK fingerprints are walked where they lie; a
    larger bucket is cut into blocks and every pair of blocks is a group of its own."""
    if max_bits > MAX_BITS:
        raise ValueError("three segments find pairs within four bits")
    ship_package(prints.sparkSession)
    small_batches(prints.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, found):
            pairs, hot = _bucket_links(keys, found, max_bits)
            n = len(pairs)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64)),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["a", "b", "key", "block", "prints"],
                )
            for key, many in hot:
                for i, at in enumerate(range(0, len(many), BLOCK)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int32()),
                         pa.array([i], pa.int32()), pa.array([many[at : at + BLOCK].tobytes()], pa.binary())],
                        names=["a", "b", "key", "block", "prints"],
                    )

        keys, found = np.empty(0, np.int32), np.empty(0, np.uint64)
        for batch in batches:  # sorted by key; the last key of a batch may go on in the next
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            found = np.concatenate([found, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:
                done = int(np.searchsorted(keys, keys[-1]))
                yield from out(keys[:done], found[:done])
                keys, found = keys[done:], found[done:]
        if len(keys):
            yield from out(keys, found)

    def pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                both = np.concatenate([np.frombuffer(v.as_py(), np.uint64) for v in (x, y)])
                if found := spanning_links(both, max_bits):
                    pairs = _signed(found)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    keyed = prints.select("fp").mapInArrow(_key_rows, "key int, fp long")
    met = cut_lineage(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(walk, LINK_ROWS))
    blocks = met.where("key is not null").select("key", "block", "prints")
    cross = (
        blocks.alias("x").join(blocks.alias("y"), "key").where("x.block < y.block")
        .select(F.col("x.prints").alias("x"), F.col("y.prints").alias("y"))
        .mapInArrow(pair_links, "a long, b long")
    )
    return met.where("key is null").select("a", "b").union(cross).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits``
    differing bits, the row's own included. Null and empty texts have fingerprint zero and
    link like any other. Rows with equal ids each keep a row; a null id is never the
    smallest, and a group of null ids only has a null component_id. Further columns of
    ``docs`` are ignored. An empty table gives an empty table."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, words))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comps = connected_components(links(prints, max_bits))
    known = prints.join(comps, prints["fp"] == comps["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    table = known.join(lowest, "component").select("fp", "component_id")
    return rows.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate group: the one with the smallest
    id (null ids last; among equal ids the smallest key of the row's content). Rows are
    told apart by their content, never by the id alone. All columns are kept as they are."""
    every, key = keyed(docs)
    rows = cut_lineage(_text_prints(every.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(key[0]).alias("high"), F.col(key[1]).alias("low"),
        F.col(text_col).cast("string").alias("text")), words))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "high", "low")
    prints = rows.groupBy("fp").agg(F.min(order).alias("first"))
    comps = connected_components(links(prints, max_bits))
    first = (
        prints.join(comps, prints["fp"] == comps["node"], "left")
        .groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
        .select(F.col("first.high").alias(key[0]), F.col("first.low").alias(key[1]))
    )
    # rows with one key are equal in all columns
    return every.join(first, key, "left_semi").dropDuplicates(key).select(*[f"`{c}`" for c in docs.columns])
