"""Cross-entropy difference: every text scored by a target and a background n-gram model.

Both are bigram models over one vocabulary: the words seen at least LEAST_COUNT times in all
documents, all others being one unknown word. They have the same kept bigrams (seen that often
too), the same absolute discount and the same interpolation with single words, so their
per-token losses can be compared. What a context's rare bigrams would get is given to no word.
The background model counts all documents, the target model those marked as target.
LEAST_COUNT is a number of occurrences and no share, so what is counted grows with the corpus.
Texts are numbered in blocks once, where they are read; only ids meet the target's ids. Each
block's distinct words and pairs are summed over all blocks by key in one exchange, and the sums
return to their blocks. What is written or exchanged goes as packed columns, in sorted order, so
that a key takes the bits that tell it from its neighbour and a sum no key at all. Nothing is
broadcast or sent to the driver but the number of blocks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.batches import light_batches
from vecframe.session import cut_lineage, ship_package, spread

LEAST_COUNT = 2
DISCOUNT = 0.75
BIGRAM_WEIGHT = 0.5      # the rest is that of the single word
UNSEEN = 0.5             # added to the count of every word of the vocabulary
BLOCK_BYTES = 16_000_000  # of text
START = 1                # stands for the word before the first

BLOCK = "block long, doc_ids array<long>, sizes binary, ids binary, hashes binary, targets array<int>"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: first the lowest byte of each, then the next."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (A-Z in lower case, parted by ASCII white space) and each one's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there), row[there.to_numpy(zero_copy_only=False)]


def groups_of(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, also of several batches, with up to ``most`` bytes of text; a longer
    text alone."""
    held, total = [], 0
    for batch in batches:
        first = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total + size > most and (held or i > first):
                yield pa.concat_batches([*held, batch.slice(first, i - first)])
                held, first, total = [], i, 0
            total += size
        held.append(batch.slice(first))
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def word_hash(word: str) -> int:
    """64 bits that stand for a word; two words share them as good as never."""
    return np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64).item()


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair, from those of its words."""
    return before * np.int64(0x1E3779B97F4A7C15) + word  # wraps around


def _number(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``(doc_id, text, target)``: their words numbered as they come."""
    task = TaskContext.get().partitionId() << 32
    for n, part in enumerate(groups_of(batches, 1, most)):
        words, row = words_of(part.column(1))
        numbered = words.dictionary_encode()
        hashes = np.array([word_hash(w) for w in numbered.dictionary.to_pylist()], np.int64)
        sizes = np.bincount(row, minlength=part.num_rows).astype(np.int64)
        targets = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False)).astype(np.int32)
        packed = [sizes, numbered.indices.to_numpy().astype(np.int32), hashes]
        yield pa.RecordBatch.from_arrays(
            [pa.array([task + n]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
             *[pa.array([pack(a)], pa.binary()) for a in packed], pa.array([targets], pa.list_(pa.int32()))],
            names=["block", "doc_ids", "sizes", "ids", "hashes", "targets"],
        )


@dataclass
class Block:
    """A block's texts; ``targets`` are the places of the target's among them, ``pairs`` the
    distinct (word before, word) keys, ``at`` each token's place among those. The number after
    the last word's stands for the start."""

    block: int
    sizes: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray
    targets: list

    @classmethod
    def of(cls, row: dict) -> Block:
        kinds = {"sizes": np.int64, "ids": np.int32, "hashes": np.int64}
        return cls(row["block"], *[unpack(row[c], t) for c, t in kinds.items()], row.get("targets") or [])

    def __post_init__(self):
        self.n = len(self.hashes)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = self.n
        return np.unique(before * (self.n + 1) + self.ids, return_inverse=True)

    @property
    def at(self) -> np.ndarray:
        return self._pairs[1]

    @cached_property
    def before_and_word(self) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(self._pairs[0], self.n + 1)

    @property
    def word_keys(self) -> np.ndarray:
        return np.append(self.hashes, START)

    @property
    def pair_keys(self) -> np.ndarray:
        before, word = self.before_and_word
        return pair_key(self.word_keys[before], self.word_keys[word])

    def counts(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        """How often each number comes, in all texts and in the target's."""
        target = np.zeros(len(self.sizes), bool)
        target[self.targets] = True
        return [np.bincount(at, minlength=size), np.bincount(at[target[self.row]], minlength=size)]

    def word_counts(self) -> list[np.ndarray]:
        """The start comes once in every text."""
        return [np.append(c, s) for c, s in zip(self.counts(self.ids, self.n), (len(self.sizes), len(self.targets)), strict=True)]

    def pair_counts(self) -> list[np.ndarray]:
        return self.counts(self.at, len(self._pairs[0]))


def sorted_keys(keys: np.ndarray) -> np.ndarray:
    """The order in which a block's keys are sent, and their sums come back."""
    return np.argsort(keys.view(np.uint64), kind="stable")


PARTS = "bucket int, block long, words boolean, keys binary, background binary, target binary"


def _parts(batches: Iterator[pa.RecordBatch], words: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, which is a range of keys, also where a block has none of them."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    for batch in batches:
        for row in batch.to_pylist():
            block = Block.of(row)
            keys, counts = (block.word_keys, block.word_counts()) if words else (block.pair_keys, block.pair_counts())
            order = sorted_keys(keys)
            keys = keys[order].view(np.uint64)
            steps = np.diff(keys, prepend=np.uint64(0))
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            steps[[c for c in cuts[:-1] if c < len(keys)]] = keys[[c for c in cuts[:-1] if c < len(keys)]]
            packed = [[pack(a[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)] for a in (steps, *[c[order] for c in counts])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, block.block)), pa.array(np.full(buckets, words)),
                 *[pa.array(p, pa.binary()) for p in packed]],
                names=["bucket", "block", "words", "keys", "background", "target"],
            )


def number_texts(marked: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the texts of ``(doc_id, text)``, written once: numbers of words instead of
    words, and the words' hashes. A boolean column ``target`` marks the target's texts."""
    ship_package(marked.sparkSession)
    light_batches(marked.sparkSession)
    target = F.col("target") if "target" in marked.columns else F.lit(False)
    rows = marked.select("doc_id", "text", target.alias("target"))
    return cut_lineage(rows.mapInArrow(lambda b: _number(b, block_bytes), BLOCK))


def word_rows(blocks: DataFrame, buckets: int = 1) -> DataFrame:
    return blocks.mapInArrow(lambda b: _parts(b, True, buckets), PARTS)


def pair_rows(blocks: DataFrame, buckets: int = 1) -> DataFrame:
    return blocks.mapInArrow(lambda b: _parts(b, False, buckets), PARTS)


def _sums(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of one bucket's parts, their counts in both models over all blocks (zero
    where they are too rare), and the place among them of every part's every key."""
    keys, places = np.unique(np.concatenate([np.cumsum(unpack(p, np.uint64)) for p in parts["keys"].to_pylist()]), return_inverse=True)
    counts = [np.concatenate([unpack(p, np.int64) for p in parts[c].to_pylist()]) for c in ("background", "target")]
    sums = np.array([np.bincount(places, c, len(keys)) for c in counts]).astype(np.int64)  # exact below 2 ** 53
    return keys.view(np.int64), sums, places


def summed(rows: DataFrame) -> DataFrame:
    """``(key, background, target)``: the keys seen often enough over all blocks."""
    def flat(parts: pa.Table) -> pa.Table:
        keys, sums, _ = _sums(parts)
        often = sums[0] >= LEAST_COUNT
        return pa.table({"key": keys[often], "background": sums[0, often], "target": sums[1, often]})

    return rows.groupBy("bucket", "words").applyInArrow(flat, "key long, background long, target long")


def _answers(parts: pa.Table) -> Iterator[pa.RecordBatch]:
    """To each part of a bucket the sums of its keys, in their order, and the bucket's totals."""
    for words in (True, False):
        own = parts.filter(pc.equal(parts["words"], words))
        if not own.num_rows:
            continue
        keys, sums, places = _sums(own)
        often = sums[0] >= LEAST_COUNT
        known = keys != START
        totals = [*sums[:, known].sum(1), *sums[:, known & often].sum(1), np.count_nonzero(known & often)] if words else []
        sums[:, ~often] = 0
        at = 0
        for row in own.select(["bucket", "block", "keys"]).to_pylist():
            n = len(unpack(row["keys"], np.uint64))
            b, t = (pack(s[places[at:at + n]]) for s in sums)
            at += n
            yield pa.RecordBatch.from_pylist(
                [{"block": row["block"], "bucket": row["bucket"], "words": words, "background": b, "target": t, "totals": totals}],
                pa.schema({"block": pa.int64(), "bucket": pa.int32(), "words": pa.bool_(), "background": pa.binary(), "target": pa.binary(),
                           "totals": pa.list_(pa.int64())}))


def answers(rows: DataFrame) -> DataFrame:
    """What ``_answers`` says, a row for each of ``rows``; a bucket at a time."""
    return rows.groupBy("bucket").applyInArrow(
        lambda parts: pa.Table.from_batches(list(_answers(parts))),
        "block long, bucket int, words boolean, background binary, target binary, totals array<long>")


@dataclass
class Totals:
    """Tokens of both models, those of known words, and the size of the vocabulary with the
    unknown word."""

    tokens: np.ndarray
    known: np.ndarray
    size: int

    def single(self, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
        own = np.where(known[:, None], counts, self.tokens - self.known)
        return (own + UNSEEN) / (self.tokens + UNSEEN * self.size)


    @classmethod
    def of(cls, buckets: list[list[int]]) -> Totals:
        """From the totals of every bucket."""
        row = np.sum([b for b in buckets if b] or [[0] * 5], axis=0)
        return cls(row[:2].astype(np.float64), row[2:4].astype(np.float64), int(row[4]) + 1)


def totals_of(words: DataFrame) -> Totals:
    return Totals.of([r["totals"] for r in answers(words).select("bucket", "totals").distinct().collect()])


def losses(block: Block, word: np.ndarray, pair: np.ndarray, totals: Totals) -> np.ndarray:
    """Negative log probabilities of the block's distinct pairs, by model (background, target),
    given the corpus' counts of its words and pairs, zero for those too rare."""
    before, after = block.before_and_word
    p = (1 - BIGRAM_WEIGHT) * totals.single(word, word[:, 0] > 0)[after]
    kept = pair[:, 0] > 0
    p[kept] += BIGRAM_WEIGHT * np.maximum(pair[kept] - DISCOUNT, 0.0) / np.maximum(word[before[kept]], 1e-9)
    return -np.log(p)


def returned(found: pa.Table, words: bool, keys: np.ndarray) -> np.ndarray:
    """A block's sums, in the order of its keys, from the answers of all buckets."""
    own = found.filter(pc.equal(found["words"], words)).sort_by("bucket")
    sums = np.empty((len(keys), 2))
    sums[sorted_keys(keys)] = np.column_stack([np.concatenate([unpack(p, np.int64) for p in own[c].to_pylist()]) for c in ("background", "target")])
    return sums


def with_target(rows: DataFrame, target_ids: DataFrame, deal: str) -> DataFrame:
    """``rows`` with a column ``target``: whether a row's ``doc_id`` is among
    ``target_ids(doc_id)``, all of which count. Never a broadcast: the plan, and so its cost a
    row, is the same at every size. Rows without an id are dealt by the column ``deal``."""
    ids = target_ids.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.lit(0).cast("long").alias("_deal")).distinct()
    dealt = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64(deal)).otherwise(F.lit(0)))
    marked = dealt.join(ids.hint("merge"), (dealt["doc_id"] == ids["_id"]) & (dealt["deal"] == ids["_deal"]), "left")
    return marked.select(*rows.columns, F.col("_id").isNotNull().alias("target"))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mark_target(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, target)``: the texts marked row by row, for which they are moved."""
    return with_target(ids_and_texts(docs, id_col, text_col), target_ids, "text")


def mark_blocks(blocks: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``blocks`` with the places of the target's texts; the ids are moved and no texts."""
    places = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    marked = with_target(places, target_ids, "place").where("target")
    found = marked.groupBy("block").agg(F.collect_list("place").alias("targets"))
    return blocks.drop("targets").join(found.hint("merge"), "block", "left")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)``, one row per row of
    ``docs``: mean losses per token in nats, and score the mean of the per-token differences
    (target less background; the lower, the more a text is like the target).

    A text without words (null or empty) has no tokens, losses and score zero. Repeated rows
    are counted and scored each; a null id is never a target. Without target rows the target
    model is that of unseen counts. Further columns are ignored; an empty table gives an
    empty table."""
    blocks = number_texts(spread(ids_and_texts(docs, id_col, text_col)), block_bytes)
    marked = mark_blocks(blocks, target_ids)
    buckets = max(1, blocks.count())  # each holds about as many keys as a block
    # words, pairs and scores all read the marked blocks, so that one exchange of blocks serves them
    found = answers(word_rows(marked, buckets).unionByName(pair_rows(marked, buckets)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block.of(row)
        totals = Totals.of(right["totals"].to_pylist())
        each = losses(block, returned(right, True, block.word_keys), returned(right, False, block.pair_keys), totals)[block.at]
        n = block.sizes
        mean = lambda x: np.bincount(block.row, x, minlength=len(n)) / np.maximum(n, 1)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": n, "target_loss": mean(each[:, 1]),
            "background_loss": mean(each[:, 0]), "score": mean(each[:, 1] - each[:, 0])})

    return marked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def quality_targets(labels: DataFrame, is_target: Column) -> DataFrame:
    """Ids of the labelled rows for which the Column holds."""
    return labels.where(F.coalesce(is_target, F.lit(False))).select("doc_id")


def scores_sql(target: str) -> str:
    """The same scores, rounded to six digits, as DuckDB SQL over ``documents`` with distinct
    ids; ``target`` is a query of target ids. Words hold no spaces, so ' start' is a free name."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    p = lambda m: f"{1 - BIGRAM_WEIGHT} * coalesce(s.single_{m}, x.single_{m}) + {BIGRAM_WEIGHT} * coalesce(k.taken_{m}, 0)"
    single = lambda b, t: f"({b} + {UNSEEN}) / (n.b + {UNSEEN} * z.size) AS single_b, ({t} + {UNSEEN}) / (n.t + {UNSEEN} * z.size) AS single_t"
    return f"""
    WITH g AS (SELECT DISTINCT doc_id FROM ({target})),
    d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM g) AS tgt,
                 list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
    t AS (SELECT doc_id, tgt, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
    n AS (SELECT count(*) AS b, count(*) FILTER (WHERE tgt) AS t FROM t),
    q AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), ' start') AS prev FROM t),
    v AS (SELECT w, count(*) AS b, count(*) FILTER (WHERE tgt) AS t FROM t GROUP BY w HAVING count(*) >= {LEAST_COUNT}),
    z AS (SELECT count(*) + 1 AS size, coalesce(sum(b), 0) AS b, coalesce(sum(t), 0) AS t FROM v),
    c AS (SELECT * FROM v UNION ALL SELECT ' start', count(*), count(*) FILTER (WHERE tgt) FROM d),
    s AS (SELECT w, {single('v.b', 'v.t')} FROM v, n, z),
    x AS (SELECT {single('n.b - z.b', 'n.t - z.t')} FROM n, z),
    k AS (SELECT p.prev, p.w, greatest(p.b - {DISCOUNT}, 0) / greatest(c.b, 1e-9) AS taken_b, greatest(p.t - {DISCOUNT}, 0) / greatest(c.t, 1e-9) AS taken_t
          FROM (SELECT prev, w, count(*) AS b, count(*) FILTER (WHERE tgt) AS t FROM q GROUP BY prev, w) p JOIN c ON c.w = p.prev
          WHERE p.b >= {LEAST_COUNT}),
    l AS (SELECT q.doc_id, -ln({p('b')}) AS b, -ln({p('t')}) AS t FROM q CROSS JOIN x LEFT JOIN s ON s.w = q.w
          LEFT JOIN k ON k.prev = q.prev AND k.w = q.w),
    m AS (SELECT doc_id, count(*) AS n_tokens, avg(t) AS t, avg(b) AS b, avg(t - b) AS x FROM l GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(m.n_tokens, 0) AS BIGINT) AS n_tokens, round(coalesce(m.t, 0), 6) + 0.0::DOUBLE AS target_loss,
           round(coalesce(m.b, 0), 6) + 0.0::DOUBLE AS background_loss, round(coalesce(m.x, 0), 6) + 0.0::DOUBLE AS score
    FROM d LEFT JOIN m ON m.doc_id = d.doc_id"""
