"""Connected components of a link table, as alternating star joins on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.session import cut_lineage

MAX_ROUNDS = 60  # a path of 2^30 nodes needs about 30; reaching it is an error, never a cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node passes its smallest neighbour (or itself) on to its larger neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    passed = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.union(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (any order, repeats and loops allowed, nulls ignored) to
    ``(node, component)``, where component is the smallest node reachable. Nodes that occur
    only in loops, or in no edge, have no row. An empty table gives an empty table.

    Each round is two aggregate-and-join steps that keep the number of edges at most the
    number of links; a hub is pre-aggregated by ``min`` and its join side is split by AQE.
    Every round is checkpointed to the shared folder."""
    now = cut_lineage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _signature(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        now = cut_lineage(_small_star(_large_star(now)).distinct())
        after = _signature(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return int(row["n"]), row["h"]
