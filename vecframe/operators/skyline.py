"""R16 in any number of measures: the rows that no other row of their group beats.

A row is beaten by one that is at least as good in every measure and better in one. Each batch
first drops the rows beaten within it; what is left of a group is cut into blocks, and every pair
of blocks meets in one task, so neither a large group nor a large front is ever held whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.session import cut_lineage, ship_package

BLOCK_ROWS = 4096


def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which ``rows`` some row of ``by`` beats (larger is better in every column). Rows of ``by``
    are tried from the largest sum down: only an earlier one can beat a later one."""
    out = np.zeros(len(rows), bool)
    best = by[np.argsort(-by.sum(axis=1), kind="stable")]
    for judge in best:
        left = np.flatnonzero(~out)
        if not len(left):
            break
        r = rows[left]
        out[left[(judge >= r).all(axis=1) & (judge > r).any(axis=1)]] = True
    return out


def skyline(df: DataFrame, measures: dict[str, bool], group: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``df`` that no row of the same ``group`` beats; ``measures`` names columns and
    whether smaller is better. Equal rows do not beat each other; NULL groups are a group; rows
    with a NULL or NaN measure take no part; an infinite measure is a value."""
    if not measures:
        raise ValueError("no measures")
    ship_package(df.sparkSession)
    group = list(group)
    goods = [f"_m{i}" for i in range(len(measures))]
    value = {g: F.col(m).cast("double") * F.lit(-1.0 if lower else 1.0) for g, (m, lower) in zip(goods, measures.items(), strict=True)}
    known = df.where(" and ".join(f"`{m}` is not null and not isnan(cast(`{m}` as double))" for m in measures))
    rows = cut_lineage(known.withColumns(value).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.xxhash64(F.lit(0), *group)))

    def local(batches):
        import pyarrow as pa

        for batch in batches:
            M, part = np.column_stack([batch.column(g).to_numpy() for g in goods]), batch.column("_part").to_numpy()
            keep = np.ones(len(M), bool)
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                keep[here] = ~beaten(M[here], M[here])
            yield batch.filter(pa.array(keep))

    narrow = rows.select("_row", "_part", *goods)
    left = cut_lineage(narrow.mapInArrow(local, narrow.schema))
    sizes = left.groupBy("_part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    placed = left.join(sizes, "_part").withColumn("_own", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    subjects = placed.withColumn("_other", other)
    again = placed.select("_blocks", *[F.col(c).alias(c) for c in ("_part", "_row", *goods)], F.col("_own").alias("_other"))
    judges = again.withColumn("_own", other).select("_part", "_own", "_other", *goods)

    def judge(mine, theirs):
        import pyarrow as pa

        get = lambda t: np.column_stack([t.column(g).to_numpy() for g in goods])
        lost = beaten(get(mine), get(theirs)) if mine.num_rows and theirs.num_rows else np.zeros(mine.num_rows, bool)
        return pa.table({"_row": mine.column("_row").to_numpy()[lost]}, schema=pa.schema([("_row", pa.int64())]))

    pair = ["_part", "_own", "_other"]
    lost = subjects.groupBy(*pair).cogroup(judges.groupBy(*pair)).applyInArrow(judge, "_row long")
    front = left.select("_row").join(lost.distinct(), "_row", "left_anti")
    return rows.join(front, "_row", "left_semi").select(*df.columns)
