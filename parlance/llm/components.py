"""Connected components by alternating large-star and small-star.

Large-star ties every node's larger neighbours to the smallest node it knows; small-star does so with its smaller
neighbours and itself. Both keep the components, and repeating them ends with one star around each component's
smallest node after a number of rounds that grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import settle


def large_star(edges: DataFrame) -> DataFrame:
    """``u, v`` with each larger neighbour v of a node tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """The same for smaller neighbours: they and the node are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns u, v); the root is the smallest node of its component.

    Each round is a settled table; only a count and a checksum of it reach the driver.
    """
    edges = settle(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        edges = settle(small_star(large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
