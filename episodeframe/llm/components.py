"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and all its v. One row per u: map-side combined, whatever the degree."""
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) of longs: root is the least node it is connected with.

    Nodes without an edge to another are not listed. Each step joins on staged tables, so Spark can
    split a hub's rows, and the number of steps grows with the logarithm of the longest chain.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both)
        spread = stage(both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        low = _stars(spread)
        joined = spread.join(low, "u")
        after = stage(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-small")
        unstage(now, large, spread, low)
        now = after
        found = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if found == mark:
            break
        mark = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
