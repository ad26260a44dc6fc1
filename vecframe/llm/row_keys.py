"""Keys of whole rows, by content, so that a recomputed task finds the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> list[Column]:
    """Two longs, together 128 bits over all columns: equal for equal rows, and for others as
    good as never. A null differs from an empty value; maps go as JSON."""
    columns = [(docs[f"`{c}`"], t) for c, t in docs.dtypes]
    values = [F.to_json(F.struct(c)) if "map<" in t else c for c, t in columns]
    nulls = F.concat(F.lit("n"), *[F.when(c.isNull(), "1").otherwise("0") for c, _ in columns])
    return [F.xxhash64(F.lit(seed), nulls, *values) for seed in (1, 2)]


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its row key in two more columns, and their names."""
    names = [unused(docs, "_high"), unused(docs, "_low")]
    return docs.withColumns(dict(zip(names, row_key(docs), strict=True))), names


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
