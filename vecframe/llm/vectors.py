"""Shared by the vector operators: which vectors take part, Arrow lists as matrices, and
spherical k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is taken out first, so that neither
    tiny nor huge vectors lose their length."""
    if not rows.size:
        return rows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sample(df: DataFrame, vec: str, rows: int) -> np.ndarray:
    """At most ``2 * rows`` vectors, about ``rows`` of them, chosen by a hash of the vector,
    so that the choice depends neither on order nor on partitions; only vectors of the
    commonest dimension among those chosen."""
    total = df.count()
    if not total:
        return np.empty((0, 0))
    share = min(1.0, rows / total)
    some = df if share == 1.0 else df.where(F.pmod(F.xxhash64(vec, F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = [r[0] for r in some.select(vec).limit(2 * rows).collect()]
    if not got:
        return np.empty((0, 0))
    sizes = np.array([len(v) for v in got])
    dim = np.bincount(sizes).argmax()
    found = np.array([v for v in got if len(v) == dim], np.float64)
    return found[np.lexsort(found.T[::-1])]  # one order, whatever order the rows came in


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows: farthest-spread start, then Lloyd rounds by cosine."""
    distinct = np.unique(rows, axis=0)
    k = min(k, len(distinct))
    rng = np.random.default_rng(42)
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        home = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centers)
    return centers
