"""Connected components as rounds of joins and aggregations over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.plans.lineage import materialise

#: Links in a file of a step.
FILE_ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)``; a component is named after its least node.

    Large-star and small-star steps in turn: every step is a join and an aggregation over the
    links, stored in between, until all links are stars. The links never grow in number, so
    a step writes as many files as their rows need. Links of a node to itself only name it.
    """
    edges = materialise(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    loops, edges = edges.where("u = v").select("u"), edges.where("u <> v")
    files = max(1, -(-edges.count() // FILE_ROWS))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialise(large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "small")
        # Done when every node has one centre, and no centre of a star belongs to another star.
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if several.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    found = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v")).unionByName(
        loops.select("u", F.col("u").alias("v")))
    return found.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
