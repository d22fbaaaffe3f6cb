"""Connected components of a table of links, without collecting it.

Sums of a node's links are stored before they are joined: a plain join of two tables is
one that Spark can split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.sources.writers import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every edge leads straight to the smallest node of its component: no node has two targets, or is both an origin and a target."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.bool_or((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = _both_ways(edges)
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; edges run from the larger to the smaller end."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    others = edges.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def near_roots(edges: DataFrame) -> DataFrame:
    """``a, b``: each node with the smallest node that two links reach; enough to join a star whose hub is any node.

    Two passes of summed minima, where ``roots`` takes as many as the longest chain asks for.
    """
    both = written(_both_ways(edges.filter(F.col("a") != F.col("b"))).distinct(), "both")
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
    met = written(both.join(least.withColumnRenamed("a", "b"), "b").select("a", "least"), "met")
    return met.groupBy("a").agg(F.min("least").alias("b")).filter("b < a")


def roots(edges: DataFrame) -> DataFrame:
    """``a, b``: each node that is not the smallest of its component, with the smallest.

    Large and small stars alternate until only stars are left; every turn is stored in the
    shared folder, which cuts the lineage.  A hot node's edges are summed before they travel.
    """
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.filter(F.col("a") != F.col("b")).select(larger.alias("a"), smaller.alias("b")).distinct(), "edges")
    while not _all_stars(edges):
        edges = written(_small_star(written(_large_star(edges), "stars")), "edges")
    return edges
