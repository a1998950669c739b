"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step moves links towards the smallest id of their neighbourhood; the number of steps grows with the logarithm of
a component's width, and no step gathers a node's links in one task: a node's smallest neighbour is an aggregate that is
written before the links are joined to it, so Spark can split the links of a hot node. Steps end when all links run to a
node that has none of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import saved


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: links from a node's larger neighbours to its smallest; small star: from its smaller ones and itself. Links may repeat."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a is the node, b a neighbour; in a small star all links run from the larger end a to the smaller b
    moved = both.join(saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least"), "a")
    if small:
        ends = moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    else:
        ends = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return ends.filter(F.col("a") > F.col("b"))


def components(links: DataFrame) -> DataFrame:
    """node, root for every node in links (a, b): root is the smallest id of its component."""
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "links")
    while not _are_stars(edges):
        edges = saved(_star(_star(edges, small=False), small=True).distinct(), "links")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """True if no node has two links down, or links both down and up: then each runs to the smallest id of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if(F.col("down") + F.col("up") > 1)).first()[0] == 0
