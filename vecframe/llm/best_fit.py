"""Best-fit packing planned on a histogram of lengths.

How many pieces there are of each length is all that best-fit decreasing needs: lengths are
placed from the longest down, each into the open sequences with the least room that holds it, and
sequences that were filled alike are one interval of sequence numbers. A plan row says: pieces of
this length, from this rank on, go to sequences from this number on, so many to a sequence, from
this offset on. Documents then take their planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.llm.row_keys import unused
from vecframe.session import cut_lineage, ship_package

MAX_TOKENS = 4096

#: Rows (length, first rank, first sequence, pieces a sequence, offset of the first).
Plan = list[tuple[int, int, int, int, int]]


def plan_slots(counts: dict[int, int], capacity: int = MAX_TOKENS) -> Plan:
    """Best-fit decreasing over ``counts`` (pieces by length, 1 to ``capacity``).

    Of the open sequences that can hold a length, those with the least room are filled first, with
    as many pieces of it as go in: what room is left after one piece is less than any other. The
    size of the plan depends on the number of lengths, never on the number of pieces: a length
    splits at most one interval of equally filled sequences and opens one."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan: Plan = []
    intervals: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, how many)
    rooms: list[int] = []                             # in order
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in intervals:
                insort(rooms, room)
                intervals[room] = []
            intervals[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = intervals[room].pop()
                if not intervals[room]:
                    del intervals[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            placed = min(left, n * each)
            full, over = divmod(placed, each)
            plan.append((length, rank, first, each, capacity - room))
            leave(room - each * length, first, full)
            if over:
                leave(room - over * length, first + full, 1)
            used = full + bool(over)
            leave(room, first + used, n - used)
            rank, left = rank + placed, left - placed
    return plan


class Slots:
    """A plan as arrays, looked up by length and rank."""

    def __init__(self, plan: Plan):
        rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
        self.key = (rows[:, 0] << 48) + rows[:, 1]
        self.rank, self.sequence, self.each, self.offset = rows[:, 1:].T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def cut_pieces(documents: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``documents(doc_id, ids)`` (ids: little-endian unsigned 32-bit integers) to ``(doc_id,
    piece, start, length, ids)``: pieces of ``max_tokens`` ids, the last of what is left. Null
    or empty ids make no piece."""
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    pieces = documents.select("doc_id", "ids", n.alias("n")).where("n > 0")
    pieces = pieces.select("doc_id", "ids", "n", F.explode(F.expr(f"sequence(0, cast((n - 1) div {max_tokens} as int))")).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * max_tokens)
    pieces = pieces.withColumn("length", F.least(F.lit(max_tokens).cast("long"), F.col("n") - F.col("start")))
    ids = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return pieces.select("doc_id", "piece", "start", "length", ids.alias("ids"))


def take_slots(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with a column ``length`` (from 1 to ``max_tokens``; other columns pass through)
    and two more columns: ``sequence_id`` and ``offset``. Pieces lie gapless in their sequence,
    which holds ``max_tokens`` at most.

    Pieces are written once with their place (task and row). A piece's rank within its length
    is its number within its task plus the pieces of that length in the tasks before, so no
    length is ever one group: a group is the rows of one length in one task, and what is summed
    over a length is one number per task. Only the histogram (``max_tokens`` rows) reaches the
    driver and only the plan, bounded by it, is broadcast. Repeated rows are pieces of their own;
    lengths null or out of range raise an error; an empty table stays empty. Columns called
    sequence_id or offset are replaced."""
    ship_package(pieces.sparkSession)
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    kept = pieces.columns
    at, task, nth, n, before = (unused(pieces, c) for c in ("_at", "_task", "_nth", "_n", "_before"))
    stored = cut_lineage(pieces.withColumn(at, F.monotonically_increasing_id()))
    placed = stored.withColumn(task, F.shiftright(at, 33))  # the id's upper bits are the task

    shares = placed.groupBy(task, "length").agg(F.count("*").alias(n))
    counts = {r[0]: int(r[1]) for r in placed.groupBy("length").agg(F.count("*")).limit(max_tokens + 1).collect()}
    if any(length is None for length in counts):
        raise ValueError("a piece has no length")
    slots = spark.sparkContext.broadcast(Slots(plan_slots(counts, max_tokens)))

    earlier = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    numbered = placed.withColumn(nth, F.row_number().over(Window.partitionBy(task, "length").orderBy(at)))
    ranked = numbered.join(shares, [task, "length"]).select(
        *[F.col(f"`{c}`") for c in kept], F.col("length").cast("long").alias(n), (F.col(before) + F.col(nth) - 1).cast("long").alias(nth)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (-2, -1))
            found = [pa.array(x) for x in slots.value.find(length, rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(work, schema)
