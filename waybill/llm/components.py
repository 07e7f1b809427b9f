"""Connected components by alternating stars, all of it in DataFrames.

A round is two groupings with map-side minima and two joins that adaptive execution can split, so neither a hub
with millions of links nor a long chain lands in one task. Rounds end when the links form stars; each round's
links are a table in the shared folder and the one before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

MAX_ROUNDS = 60


def _stars(links: DataFrame, every: bool) -> DataFrame:
    """Large star (``every``): link each larger neighbour of a node to the least of its neighbourhood.
    Small star: link the node and its smaller neighbours to the least of them. ``links``: hi > lo."""
    if every:
        near = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        near = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if every:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node that it reaches.
    Nodes without a link do not appear. Repeated links, links to oneself and null ends are ignored."""
    spark = links.sparkSession
    now, path = staged(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    if now.isEmpty():
        return now.selectExpr("hi as node", "lo as root")
    for _ in range(MAX_ROUNDS):
        then, then_path = staged(_stars(_stars(now, True), False), "links")
        # Stars: no centre is itself a leaf, and each leaf has one centre.
        settled = then.select("lo").distinct().join(then.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").isEmpty()
        settled = settled and then.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        drop_staged(spark, path)
        now, path = then, then_path
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root")))
