"""Connected components of links, for identities that share keys in chains.

Rounds of large-star and small-star: the number of rounds grows with the logarithm of the longest chain, a hub of any degree
is met in minimum aggregates and joins, and no neighbourhood is gathered. Each round is staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.plans.staging import staged


def _to_neighbours(e: DataFrame) -> DataFrame:
    """Greater neighbours of each node, linked to the least of it and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _to_least(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node and the node itself, linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("low"))
    moved = e.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (u, v of one orderable type) but the roots; the root is the least node."""
    e = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        if now[0] == 0:
            break
        before, e = now, staged(_to_least(_to_neighbours(e)), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
