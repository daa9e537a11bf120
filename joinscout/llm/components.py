"""Connected components by alternating large-star and small-star steps, for links too many for any one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinscout.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `links` (a, b; long); component is the smallest node reachable.

    Each round is written to the shared folder. A node of many links never gathers them in a task: steps take minima
    by partial aggregation and join them back, which skew joins can split.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        around = edges.select(F.col("v").alias("at"), "v").union(edges.select(F.col("v").alias("at"), F.col("u").alias("v"))).union(edges.select(F.col("u").alias("at"), "v"))
        least = around.groupBy("at").agg(F.min("v").alias("m"))
        large = edges.join(least, edges.v == least["at"]).select("u", F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(own, large.u == own["at"]).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("at", "m")).distinct()
        after = scratch.keep(small)
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
