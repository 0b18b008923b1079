"""Connected components of an edge table, by alternating star contractions; no node's edges meet in one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of long nodes; returns (node, root) for every node of an edge, root being the least node it reaches.

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller ones; the tables of the
    rounds go to the shared folder, where the last one stays. It ends when a round changes nothing.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # (node, neighbour)
        # Least neighbours are tables of their own: a join of two plain exchanges can split a node of many neighbours over tasks.
        least = saved(both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m")), "least")
        large = saved(both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
        lowest = saved(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        then = saved(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        forget(now, least, large, lowest)
        found = _mark(then)
        now = then
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
