"""Places of sorted rows without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.closure import use_checkpoint_dir

# A row's number in its task, below the number of the task: how Spark makes rising ids.
_TASK_BITS = 33


def with_ordinals(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """``df`` sorted, each row with its place from 1 under ``name``.

    The sort deals rows to ranges and is checkpointed, so ranges and places agree even if a task
    runs twice. A row's place is that in its range, plus the rows of the ranges before: one number
    for each range goes through the driver. Equal rows get places in any order, so for fixed places
    ``order`` must tell rows apart.
    """
    use_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", _TASK_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: r.part)
    begins = accumulate((r.n for r in counts), initial=0)
    before = df.sparkSession.createDataFrame(
        [(r.part, begin) for r, begin in zip(counts, begins, strict=False)], "__part long, __begin long"
    )
    inside = F.col("__at").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    return (
        placed.join(F.broadcast(before), part == F.col("__part"))
        .withColumn(name, F.col("__begin") + inside + 1)
        .drop("__at", "__part", "__begin")
    )
