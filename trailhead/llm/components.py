"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("parent", "child")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return both.filter(F.col("other") > F.col("node")).join(least, "node").select(
        F.col("other").alias("child"), F.col("least").alias("parent")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(
        F.greatest("child", "parent").alias("node"), F.least("child", "parent").alias("other")
    ).filter(F.col("node") != F.col("other"))
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    others = down.join(least, "node").filter(F.col("other") != F.col("least")).select("other", "least")
    return others.union(least).toDF("child", "parent")


def components(links: DataFrame) -> DataFrame:
    """child, parent: every linked node but the smallest of its component, and that smallest node.

    `links` has two columns of one integer type, in any order and with repeats. The rounds grow with the
    logarithm of the number of nodes; each works on at most as many edges as there are links.
    """
    edges, seen = links.toDF("child", "parent").filter("child <> parent").distinct(), None
    while True:
        edges = stage(_small_star(_large_star(edges)).distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent"))).first()
        if state == seen or state[0] == 0:
            return edges
        seen = state
