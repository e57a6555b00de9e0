"""Connected components of a link table, by alternating large- and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.shared import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): the smallest node that each linked node can reach.

    Every round links each node to the smallest of its neighbours, on the upper and then
    on the lower side, so paths shrink to stars in a logarithmic number of rounds and no
    neighbourhood is ever gathered: only its minimum is. Null and self links are ignored;
    nodes without a link have no row.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b").distinct(), "links")
    before = _print(edges)
    while True:
        both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        # Large star: each neighbour above a node is linked to the least around that node.
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: the neighbours below a node, and the node, are linked to the least of them.
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(below.select("hi", F.col("m").alias("lo"))).distinct()
        after = stored(small, "links")
        now = _print(after)
        dropped(edges)
        edges = after
        if now == before:
            return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = now


def _print(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
