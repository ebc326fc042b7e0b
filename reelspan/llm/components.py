"""Connected components by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected Components
in MapReduce and Beyond" (2014).  Each step is a minimum per node (pre-aggregated
before the shuffle) joined back to the links, so a hub with a third of all links
is never one task's list; AQE splits its partition.  Every step is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.scratch import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u > v)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    to_least = lambda node: F.struct(F.col(node).alias("u"), F.col("m").alias("v"))
    if large:
        out = moved.where("v > u").select(to_least("v").alias("l"))
    else:
        out = moved.select(F.explode(F.array(to_least("v"), to_least("u"))).alias("l"))
    return written(out.select("l.*").where("u != v").distinct(), "star")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node in ``links`` (two bigint columns)."""
    a, b = links.columns
    now = written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star"
    )
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found["n"], found["s"]) == mark or not found["n"]:
            break
        mark = (found["n"], found["s"])
        now = _star(_star(now, large=True), large=False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
