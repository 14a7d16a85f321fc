"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) of every id in links(a, b), by alternating large and small stars.

    Stars halve path lengths, so rounds grow with the logarithm of the longest path;
    each round is written to the shared folder. Minima are aggregated before the join,
    so a node of very high degree is reduced on the map side.
    """
    edges = written(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "components")
    state = None
    while state != (now := _state(edges)):
        state = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "components")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
