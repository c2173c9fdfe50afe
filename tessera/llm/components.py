"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger end (u) to the smaller (v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v")


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to its component: no node has two edges up, or one up and one from below."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: u long, v long, repeats, loops and either direction allowed. Returns node, component (the least node that
    it reaches) for every node that some edge has with a component other than itself. Nothing is collected but whether a round
    was the last; each round is cut off through the shared checkpoint folder. Empty edges: no rows."""
    now = checkpointed(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = checkpointed(_small_star(_large_star(now).distinct()).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
