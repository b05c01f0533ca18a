"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.tables import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, down, up): the least of every node and its neighbours, and how many of these are smaller and larger."""
    both = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up"))
    return both.select("u", F.least("m", "u").alias("m"), "down", "up")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to the least node that it sees."""
    return _both_ways(edges).where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v); component is the least node reachable.

    Steps are written tables, so lineage stays short; the loop ends when the edges are a forest of stars: no node has
    two smaller neighbours, or one smaller and a larger.  Then the least that a node sees is its component.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star-edges")
    least = written(_least(now), "star-least")
    while least.where("down > 1 or (down > 0 and up > 0)").limit(1).count():
        now = written(_small_star(_large_star(now, least)).distinct(), "star-edges")
        least = written(_least(now), "star-least")
    return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
