"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v -> the same, nodes hung onto the smallest neighbour of their common one.

    large star: each larger neighbour of a node goes to the smallest of the node and its neighbours.
    small star: each smaller neighbour of a node, and the node itself, does.
    """
    if small:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    else:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = around.groupBy("n").agg(F.min("o").alias("_least")).withColumn("m", F.least("n", "_least")).select("n", "m")
    if small:
        hung = around.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
        hung = hung.unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        hung = around.filter(F.col("o") > F.col("n")).join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    return _distinct_edges(hung)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that an edge (u, v) names; component: the smallest node it reaches.

    Each round halves the depth of the trees at least, so rounds grow with the logarithm of the longest path.
    Rounds end once every node hangs on a root: no node is both upper and lower end of an edge, and none has
    two lower ends. A node's many neighbours are never gathered in a row: steps join and take minima.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialise(_distinct_edges(edges))
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
        if not ends.filter("ups > 1 or (ups = 1 and all > 1)").limit(1).count():
            break
        edges = materialise(_star(_star(edges, small=False), small=True))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
