"""Reachability in a hierarchy by squaring, with its rounds kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.skew import fan_out_join
from cartulary.semantics import DEFAULT_TUNING, Tuning

PAIR = ("ancestor", "descendant")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``.

    Where it is unset they go beside the tables, into the session's warehouse, which all executors
    share as well. Checkpoints that are no longer referred to are removed by Spark where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", f"{warehouse}/_checkpoints"))


def descendants(parents: DataFrame, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """``ancestor, descendant, depth`` of ``parents(child, parent)``, one row per pair.

    ``depth`` is the least number of steps. Before round k all pairs of a depth of up to ``2 ** k``
    are known. A way of up to twice that depth has a node exactly ``2 ** k`` steps up, so the round
    only joins the pairs of that depth to all known ones; a pair known before, by a shorter way or
    around a cycle, is left out. So the rounds are the logarithm of the depth, and each pair of a
    tree is made once. The relation is checkpointed in each round, as one. A node is not its own
    descendant. One node may be below or above very many others: such keys are split.
    """
    use_checkpoint_dir(parents.sparkSession)
    known = (
        parents.where("parent <> child")
        .selectExpr("parent AS ancestor", "child AS descendant", "1 AS depth")
        .distinct()
        .checkpoint()
    )
    reach = 1
    while True:
        longest = known.where(F.col("depth") == reach)
        if longest.isEmpty():
            return known
        lower = longest.selectExpr("ancestor AS middle", "descendant")
        upper = known.selectExpr("descendant AS middle", "ancestor", "depth AS above")
        met = fan_out_join(lower, upper, "middle", ["descendant"], ["ancestor"], tuning=tuning)
        new = (
            met.where("ancestor <> descendant")
            .groupBy(*PAIR)
            .agg(F.expr(f"CAST(min(above) + {reach} AS INT) AS depth"))
            .join(known.select(*PAIR), list(PAIR), "left_anti")
        )
        known = known.unionByName(new).checkpoint()
        reach *= 2
