"""Connected components of a graph of any size, by alternating star contractions.

Every round is two grouped minima and joins; nothing about the graph visits the driver but two numbers per round.
A node with very many links costs no task more than others: minima combine before the shuffle, and adaptive
execution splits the join on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (a, b), a > b: neighbours of each node move to the smallest of them."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    # Written, so that adaptive execution may split the join on a node with very many links.
    least = written(least.select(F.col("a").alias("node"), F.least("a", "low").alias("low")), "least")
    met = both.join(least, both["a"] == least["node"])
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = met.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; a component's root is its smallest node.

    Self-links and repeated links are harmless, links with a null end are ignored, no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    links = links.filter(x.isNotNull() & y.isNotNull() & (x != y))
    links = written(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        links = written(_star(written(_star(links, large=True), "links"), large=False), "links")
