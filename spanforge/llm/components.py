"""Connected components of an edge table by large-star and small-star steps.

Every step is joins and grouped minima; what is kept between steps is written
to the shared folder. A node with very many edges is one side of a join between
two written tables, where adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, staged


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node that has a lesser one."""
    return staged(edges.where("v < u").groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greater neighbours go to the least neighbour; repeats are left for the next step."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = _least(both)
    up = both.where("v > u").join(least, F.col("u") == F.col("n"), "left")
    return up.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lesser neighbours, and the node itself, go to the least of them."""
    least = _least(edges)
    joined = edges.join(least, F.col("u") == F.col("n"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct(), least


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other and none of those points on."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of an edge (a, b)."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        for step in (_large_star, _small_star):
            new, least = step(now)
            new = staged(new, "edges")
            dropped(now)
            dropped(least)
            now = new
    both = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return now.select(F.explode(both).alias("e")).select("e.*").distinct()
