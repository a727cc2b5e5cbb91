"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import stored


def _lowest(links: DataFrame, key: str, other: str) -> DataFrame:
    """``key, m``: the least of a node and its neighbours, combined before the shuffle."""
    return links.groupBy(F.col(key).alias("k")).agg(F.least(F.min(other), F.first(key)).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links(u, v)``; a component is its least node.

    Each round links the neighbours of a node to the least of them, first the larger ones, then
    the smaller. The links never become more than they were, and rounds grow with the logarithm of
    the nodes. Rounds are written to the shared folder. Loops and repeats are allowed.
    """
    ordered = links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now, before = stored(ordered.distinct(), "links"), None
    while True:
        sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        state = tuple(now.agg(F.count("*"), sums).first())
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_lowest(both, "u", "v"), F.col("u") == F.col("k"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stored(large, "links")
        low = _lowest(large, "u", "v")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
