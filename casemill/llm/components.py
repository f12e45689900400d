"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import compact, discard, join_groups, scratch, stash


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_groups(near.where("b > a"), least, ["a"], "n", 2 * count, "inner", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_groups(edges, least, ["a"], "n", count, "inner", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: longs), root being its component's least node.

    Alternating large and small stars (Kiveris et al. 2014): minima are aggregated before
    the shuffle, nothing is gathered by node, and a hub's edges meet its minimum in a join
    that deals them to many tasks. The loop ends when a round changes no edge, seen by a count and a sum
    of hashes. Each round is stored on shared storage and the one before removed.
    """
    spark = edges.sparkSession
    current = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = _seal(current)
    while seal[0]:
        with scratch(spark):
            after = stash(compact(_small_star(_large_star(current, seal[0]), seal[0]), 2 * seal[0]))
        discard(current)
        before, seal, current = seal, _seal(after), after
        if seal == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _seal(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)
