"""Connected components of a link table by alternating large-star and small-star.

Every pass replaces the links by links to smaller ids and is written to the shared folder, so lineage stays short and a
lost executor costs one pass at most. Nothing is collected but two numbers a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(u, v)`` to ``(u, v)``: each node that has a link and isn't its component's smallest, and that smallest."""
    at = scratch.write(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        new = scratch.write(_small_star(_large_star(at).distinct()).distinct(), "stars")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(at)
        at = new
        if now == before:
            return at
        before = now
