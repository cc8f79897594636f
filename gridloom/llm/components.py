"""Connected components of an edge table by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common


def _minima(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; partial minima come before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (u long, v long).

    Each round is two group-minima with a join back and ends in a table in the shared folder, so
    that lineage stays short; the number of rounds grows as the logarithm of the longest path.
    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    state = _common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_minima(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = _common.written(small.where("u <> v").distinct(), "edges")
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
