"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of links (a, b) that isn't its component's least node, with that least node.

    Each round's links are written to the shared folder. A round compares a node's links with their least end, found by a
    pre-aggregated minimum, so a node with very many links is no group of one task. Rounds end when the links form stars
    around least nodes.
    """
    edge = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.keep(links.where("a <> b").select(edge.alias("e")).select("e.*").distinct())
    while True:
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("x"), F.lit(1).alias("y")))
        if ends.groupBy("n").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x + y > 1 and x > 0").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = scratch.keep(small.where("a <> b").distinct())
        scratch.drop(now)
        now = new
