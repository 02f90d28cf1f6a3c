"""Connected components by alternating large-star and small-star contraction.

The method is that of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every child has one parent and no parent is a child."""
    child = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parent = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    per_node = child.unionByName(parent).groupBy("node").agg(
        F.sum("up").alias("up"), F.max("down").alias("down")
    )
    return per_node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("m"))
    least = least.withColumn("m", F.least("m", "x"))
    return (
        join_keyed(both, least, "x", "n", "y")
        .where(F.col("y") > F.col("x"))
        .select(F.col("y").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
    moved = join_keyed(edges, least, "u", "n", "v").where(F.col("v") != F.col("m"))
    kept = least.select("u", F.col("m").alias("v"))
    return kept.unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b``; root is the least node.

    Each round is written to shared storage, so the plan does not grow. ``edges`` should be a
    stored table, as it is read more than once. Nodes without an edge to another node do not
    appear.
    """
    linked = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = linked.distinct()
    while not _is_star_forest(current):
        current = materialize(_small_star(_large_star(current)), "edges")
    children = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return children.unionByName(roots)
