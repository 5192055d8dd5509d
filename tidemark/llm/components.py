"""Connected components of a graph of links, all in DataFrame joins and aggregates.

Each round hooks every node to its smallest neighbour, shortens the pointers of that forest until they reach the roots,
and replaces the ends of the remaining links by their roots. Links inside a component vanish, so rounds shrink quickly.
Every round is cut by a checkpoint in the shared folder. Pointers are broadcast while a count shows that they are few; larger
ones are joined by a shuffle, but for the nodes that very many rows point to (grouping.join_unique). Otherwise nothing but
counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .grouping import join_unique


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, larger end first, without loops or nulls."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _to_roots(forest: DataFrame, count: int) -> DataFrame:
    """forest(node, parent), parent < node: the same with every parent replaced by the root above it."""
    while True:
        up = forest.select(F.col("node").alias("n2"), F.col("parent").alias("p2"))
        step = join_unique(forest, "parent", up, "n2", count, count).select(
            "node", F.coalesce("p2", "parent").alias("parent"), F.col("p2").isNotNull().alias("moved")
        )
        forest = cut(step)
        if forest.where("moved").isEmpty():
            return forest.select("node", "parent")
        forest = forest.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type, in any order, repeats and loops allowed -> (node, component): component is the
    smallest node reachable. Nodes without a link to another node are not listed."""
    links = cut(_ordered(edges))
    labels = None
    while not links.isEmpty():
        pointers = cut(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        count = pointers.count()
        roots = _to_roots(pointers, count)
        if labels is None:
            nodes = links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
            labels = nodes.withColumn("component", F.col("node"))
        above = roots.toDF("r_node", "r_parent")
        labels = cut(join_unique(labels, "component", above, "r_node", count).select("node", F.coalesce("r_parent", "component").alias("component")))
        ends = join_unique(join_unique(links, "hi", roots.toDF("an", "ap"), "an", count), "lo", roots.toDF("bn", "bp"), "bn", count)
        links = cut(_ordered(ends.select(F.coalesce("ap", "hi").alias("a"), F.coalesce("bp", "lo").alias("b"))))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
