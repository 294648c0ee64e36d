"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import saved_table


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component), the component named by its smallest node.

    Only nodes with an edge appear. Each round is two aggregations with map-side minima and two
    joins, written to the shared folder; a hub of any degree is a minimum, never a collected list.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, mark = _saved(edges.distinct())
    while mark[0]:
        before = mark
        stars, mark = _saved(_small_star(_large_star(stars)))
        if mark == before:
            break
    centers = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return centers.union(stars.select(F.col("a").alias("node"), F.col("b").alias("component")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang all larger neighbours of a node on its smallest neighbour, or on itself."""
    links = edges.union(edges.select("b", "a"))
    # Written first, so that the join can split the neighbours of a hub over tasks.
    least = saved_table(links.groupBy("a").agg(F.min("b").alias("least")), "components-least")
    larger = links.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    smaller = edges.join(least, "a").where("b <> least")
    return smaller.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least).distinct()


def _saved(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written table with its row count and order-free sums, which are equal for equal tables."""
    table = saved_table(edges, "components")
    wide = "decimal(38,0)"
    sums = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(wide)), F.sum(F.col("b").cast(wide)))
    return table, tuple(sums.first())
