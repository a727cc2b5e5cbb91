"""Sharding by longest processing time: groups of equal texts to the least loaded shard.

Groups that must stay together are sorted by size, the largest first, and each goes to the shard
with the least load so far, found by a heap. Scheduling one by one is only for groups that matter
on their own: those of at least a ``fineness``-th of a shard, at most ``shards * fineness`` of them
by arithmetic. All others are dealt by a hash of their text into a fixed number of bundles, graded
in size so that small ones come last and even out the loads; a bundle is then scheduled as a group.
So the heap sees a bounded number of items at any input size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartulary.llm.common import stored

#: Bundles of one grade, and of how much of the hash range each grade takes.
BUNDLES = 4096
GRADES = (0.75, 0.1875, 0.046875, 0.015625)
#: Groups of at least a shard's share divided by this are scheduled on their own.
FINENESS = 1024
#: Rows of a shard that get their slots in one sorted run.
SLOT_ROWS = 1 << 18


def schedule(items: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Largest first to the least loaded shard; ties by item, then by shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(key: Column) -> Column:
    """Number of the bundle of a group: the grade by one part of a hash, the place by another."""
    where = F.pmod(F.xxhash64(key, F.lit("grade")), F.lit(1 << 20)) / float(1 << 20)
    place = F.pmod(F.xxhash64(key), F.lit(BUNDLES)).cast("int")
    edge, grade = 0.0, F.lit(len(GRADES) - 1)
    for i, share in enumerate(GRADES[:-1]):
        edge += share
        grade = F.when((where < edge) & (grade == len(GRADES) - 1), F.lit(i)).otherwise(grade)
    return grade * BUNDLES + place


def place_groups(
    sized: DataFrame, key: str, size: str, shards: int, fineness: int = FINENESS
) -> DataFrame:
    """Adds ``shard`` to rows; rows of one ``key`` get one shard, a null key counts as one.

    The totals by group are combined before their shuffle. The driver gets the large groups and
    the bundle totals, at most ``shards * fineness + 4 * BUNDLES`` rows.
    """
    spark = sized.sparkSession
    groups = sized.groupBy(key).agg(F.sum(size).alias("__group_size"))
    groups = groups.withColumn("__bundle", _bundle(F.col(key)))
    total = sized.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    least = max(1, -(-total // (shards * fineness)))
    large = groups.where(F.col("__group_size") >= least)
    small = groups.where(F.col("__group_size") < least)
    items: list[tuple[object, int]] = [
        (("group", _plain(row[key]), row["__bundle"]), row["__group_size"])
        for row in large.collect()
    ]
    items += [
        (("bundle", None, row["__bundle"]), row["n"])
        for row in small.groupBy("__bundle").agg(F.sum("__group_size").alias("n")).collect()
    ]
    placed = schedule(items, shards)
    kind = sized.schema[key].dataType
    own = [(k[1], s) for k, s in placed.items() if k[0] == "group"]
    bundles = [(k[2], s) for k, s in placed.items() if k[0] == "bundle"]
    by_key = _rows(spark, own, "__own", kind, "__own_shard")
    by_bundle = _rows(spark, bundles, "__of", T.IntegerType(), "__bundle_shard")
    joined = sized.withColumn("__bundle", _bundle(F.col(key)))
    joined = joined.join(F.broadcast(by_key), F.col(key).eqNullSafe(F.col("__own")), "left")
    joined = joined.join(F.broadcast(by_bundle), F.col("__bundle") == F.col("__of"), "left")
    shard = F.coalesce("__own_shard", "__bundle_shard").cast("int").alias("shard")
    return joined.select(*sized.columns, shard)


def _plain(value: object) -> object:
    return bytes(value) if isinstance(value, bytearray) else value


def _rows(spark: SparkSession, rows: list, key: str, kind: T.DataType, value: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, kind), T.StructField(value, T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def number_slots(placed: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard.

    A shard is cut by a hash into runs of about ``SLOT_ROWS`` rows, each numbered by itself and
    moved by the rows of the runs before it.
    """
    counts = placed.groupBy(shard).count().agg(F.max("count").alias("n")).first()["n"] or 0
    runs = max(1, -(-counts // SLOT_ROWS)) * 4
    cut = placed.withColumn("__run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    before = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(F.col(shard).alias("__s"), F.col("__run").alias("__r"))
        .count()
        .select("__s", "__r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy(shard, "__run").orderBy(*order)
    numbered = cut.withColumn("__n", F.row_number().over(within) - 1)
    joined = numbered.join(
        starts, (F.col(shard) == F.col("__s")) & (F.col("__run") == F.col("__r")), "left"
    )
    slot = (F.col("__start") + F.col("__n")).cast("long").alias(name)
    return joined.select(*placed.columns, slot)


def shard_documents(docs: DataFrame, shards: int = 16, fineness: int = FINENESS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    Law ``bytes``: the shards' sizes are as near as groups of equal texts allow. ``size`` is the
    UTF-8 bytes of the text plus 1. Null texts are one group of size 1 each, apart from empty
    texts; a null text's checksum is that of no bytes. Repeated rows are equal texts and stay
    together, each with its own slot. An empty table gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group_key"),
    )
    sized = stored(sized, "sizes")
    placed = place_groups(sized, "group_key", "size", shards, fineness).drop("group_key")
    slots = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
