"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _nearest(pairs: DataFrame) -> DataFrame:
    """With each u its smallest neighbour: a sum made before the shuffle, so that a hub is one row a task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root` for every node that has a link to another; root is the smallest node reachable.

    Each round joins links with one row a node, which AQE splits where a hub is hot; the number of rounds grows with the
    logarithm of the longest chain. Every round is written to the shared folder. Nulls and self-links are ignored.
    """
    edges = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "star")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("v", "u"))
        large = both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u > v").distinct()
        small = large.join(_nearest(large), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = store(small.filter("u > v").distinct(), "star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
