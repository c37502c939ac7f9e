"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for the ids of the undirected links (a, b), two bigints; comp is the smallest id reachable.

    Alternates the large-star and small-star steps, each a minimum per id and a join, until the
    edges no longer change; the number of rounds grows with the logarithm of the diameter.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select("v", F.col("m").alias("u")).union(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        before, edges = edges, stage(small, "edges")
        unstage(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("v").agg(F.min("u").alias("comp")).select(F.col("v").alias("id"), "comp").union(edges.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct())
        seen = now
