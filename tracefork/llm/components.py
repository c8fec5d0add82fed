"""Connected components of a table of links, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefork.session import durable

MAX_ROUNDS = 60


def contracted(edges: DataFrame) -> DataFrame:
    """One round over the links ``u`` > ``v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = larger.where("u <> v").distinct()
    joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``component``) of every id in the links ``a``, ``b``; the component is its smallest id.

    Each round ties every id to the smallest of its neighbours, first among its larger and then among its smaller
    neighbours, until each is tied to the smallest of all. Links stay in tables; the driver sees two sums a round.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = durable(contracted(edges))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    tied = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = tied.select(F.col("component").alias("id"), "component").distinct()
    return tied.unionByName(roots)
