"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.tables import stored


BROADCAST_LINKS = 1_000_000  # minima of so many links, two numbers each, are broadcast; beyond it the join is left to Spark


def _small_star(down: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(side(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _large_star(down: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _all_stars(down: DataFrame) -> bool:
    """Whether every node has one link down, or only links from above: then all point at their roots."""
    ends = down.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(down.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("below")))
    count = ends.groupBy("node").agg(F.count("below").alias("below"), F.count(F.lit(1)).alias("all"))
    return count.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("all") > 1))).isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; the root is the component's smallest node.

    Each round shuffles links only and writes them to the shared folder. A hub
    is summed map-side into its minimum and joined back, so its links are never
    gathered; the number of rounds grows with the logarithm of the longest
    chain. Self links and NULL ends are ignored; a node without links is absent.
    """
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = stored(down, name)
    while not _all_stars(now):
        side = F.broadcast if now.count() <= BROADCAST_LINKS else lambda df: df
        now = stored(_small_star(_large_star(now, side), side), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
