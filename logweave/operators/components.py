"""Connected components by alternating large-star and small-star steps, no part of which is on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node of the component of each node that stands in an edge.

    edges are undirected; repeated edges are fine, rows with a null end are ignored, and an edge to itself gives
    a node of its own. Only nodes of edges have a row. Each round moves links to the smallest node seen, so
    the rounds grow with the logarithm of the largest component's size; each is written to the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    loops = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        # Large star: each node's larger neighbours get its smallest one.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node's smaller neighbours, and itself, get the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        before, links = links, cut(small.filter("u <> v").distinct())
        drop(before)
        now = tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return loops.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
