"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import saved


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for each node of links (a, b).

    Large-star and small-star steps in turn: every node's neighbours are hung on its smallest neighbour, until nothing
    changes, however many rounds that takes.  A step is one aggregation, with minima taken before the shuffle, and one join on the node, whose
    partition Spark's adaptive skew handling splits where a node has very many links; only two numbers of each round reach the driver.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(hung.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("u").alias("node"), "component").unionAll(
        nodes.select(F.col("component").alias("node"), "component").distinct())
