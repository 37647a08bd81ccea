"""Connected components over an edge table, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import remove, written_at


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One contraction: link what stands at one side of u to the least of u's neighbours and itself."""
    if both_ways:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    edges: u, v of one orderable type. Self loops and repeated edges are allowed; rows with a null end are ignored.
    An empty table gives an empty one. Work per round is a few shuffles of the remaining edges, rounds grow with the
    logarithm of the largest component, and neither edges nor components reach the driver. Each round is a written
    table, so that a lost executor costs one round at most.
    """
    now, path = written_at(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        (rows, total) = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if rows == 0 or (rows, total) == mark:
            break
        mark = (rows, total)
        following, there = written_at(_stars(_stars(now, True), False), "edges")
        remove(now.sparkSession, path)
        now, path = following, there
    # every edge is now (node, least node of its component)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
