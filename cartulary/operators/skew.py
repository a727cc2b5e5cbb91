"""Joins and groups that stay balanced when one key holds a large share of the rows.

Two situations occur. Many rows look up one row of a table that is unique by key: the table is
broadcast where it fits, else the join is left to Spark's own split of skewed partitions, which
copies only what meets them. And two sides fan out against each other: only the keys that are
really hot are split, found by a count that combines before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.jsonx import quote
from cartulary.semantics import DEFAULT_TUNING, Tuning


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate, the number Spark's own broadcast choice uses."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def _broadcast_limit(spark: SparkSession, tuning: Tuning) -> int:
    limit = _session_limit(spark)
    return limit if tuning.broadcast_bytes is None else min(limit, tuning.broadcast_bytes)


def _session_limit(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.lower().removesuffix("b").strip()
    if digits and digits[-1] in units:
        return int(digits[:-1]) * units[digits[-1]]
    return int(digits)


def fits_broadcast(lookup: DataFrame, tuning: Tuning = DEFAULT_TUNING) -> bool:
    size = estimated_bytes(lookup)
    return size is not None and size <= _broadcast_limit(lookup.sparkSession, tuning)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    row_key: str,
    lookup_key: str,
    how: str = "inner",
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Join ``rows`` to a lookup; the lookup's key column is dropped.

    A lookup within the broadcast limit is broadcast. A larger one is shuffled once, as are the
    rows; adaptive execution splits the partition of a key that very many rows look up, or
    broadcasts after all what turns out small. Columns of the two sides must differ in name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    small = fits_broadcast(lookup, tuning)
    if tuning.lookups is not None:
        lookup = tuning.lookups.watch(lookup, lookup_key)
    if small:
        lookup = F.broadcast(lookup)
    condition = F.expr(f"{quote(row_key)} = {quote(lookup_key)}")
    return rows.join(lookup, condition, how).drop(lookup_key)


def key_counts(rows: DataFrame, key: str, count: str = "n_rows") -> DataFrame:
    """Rows per key, NULL keys left out; combined before the shuffle."""
    counted = F.expr(f"count(1) AS {count}")
    return rows.where(f"{quote(key)} IS NOT NULL").groupBy(key).agg(counted)


def hot_keys(
    counts: DataFrame, key: str, count: str = "n_rows", tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """``(hot_key, pieces)`` of all keys that count at least ``tuning.hot_rows`` rows.

    The counts are exact, so a recomputed task sees the same keys, and the keys are at most the
    rows divided by ``hot_rows``.
    """
    size = tuning.hot_rows
    return counts.where(f"{count} >= {size}").selectExpr(
        f"{quote(key)} AS hot_key", f"CAST(ceil({count} / {size}) AS INT) AS pieces"
    )


def _with_pieces(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    return df.join(F.broadcast(hot), F.expr(f"{quote(key)} = hot_key"), "left")


def spread_hot(
    df: DataFrame, key: str, hot: DataFrame, by: Sequence[str], salt: str = "salt"
) -> DataFrame:
    """Give each row of a hot key one piece number, 0 for every other row."""
    apart = ", ".join(quote(name) for name in by)
    piece = f"coalesce(CAST(pmod(xxhash64({apart}), pieces) AS INT), 0) AS {salt}"
    return _with_pieces(df, key, hot).selectExpr(*map(quote, df.columns), piece)


def replicate_hot(df: DataFrame, key: str, hot: DataFrame, salt: str = "salt") -> DataFrame:
    """Repeat each row of a hot key under every piece number, others once under 0."""
    pieces = f"explode(sequence(0, coalesce(pieces, 1) - 1)) AS {salt}"
    return _with_pieces(df, key, hot).selectExpr(*map(quote, df.columns), pieces)


#: Pieces of pairs that a task joins on average, so that tasks are about as long as each other.
TASK_PIECES = 8


def _pair_pieces(left: DataFrame, right: DataFrame, key: str, weight: str, tuning: Tuning) -> DataFrame:
    """``hot_key, pairs, l, r``: per key the rows its join makes and the pieces of its two sides.

    Pieces of both sides are as large as each other where both are long, so that few rows are repeated;
    ``l * r`` pieces make ``tuning.hot_pairs`` rows each. A side has no more pieces than rows.
    """
    rows, pairs = tuning.hot_rows, f"{tuning.hot_pairs}D"
    held = right.where(f"{quote(key)} IS NOT NULL").groupBy(key)
    counted = held.agg(F.expr("count(1) AS n_right"), F.expr(f"CAST(sum({weight}) AS DOUBLE) AS w"))
    both = key_counts(left, key, "n_left").join(counted, key, "full_outer")
    both = both.selectExpr(
        f"{quote(key)} AS hot_key", *(f"coalesce({n}, 0) AS {n}" for n in ("n_left", "n_right", "w"))
    ).selectExpr("*", "n_left * w AS pairs")
    side = f"least({rows}, greatest(sqrt({pairs}), {pairs} / greatest(n_left, 1)))"
    return both.selectExpr(
        "*", f"greatest(least(n_right, ceil(w / {side})), 1) AS r"
    ).selectExpr(
        "hot_key",
        "pairs",
        f"greatest(ceil(n_left / {rows}), least(n_left, ceil(pairs / {pairs} / r)), 1) AS l",
        "r",
    )


def fan_out_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_by: Sequence[str],
    right_by: Sequence[str],
    weight: str = "1",
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Inner join on ``key``, which may be hot on either side.

    The rows of a key hot on one side are split into pieces and the other side's rows of that
    key are repeated for each. ``*_by`` are columns that tell the rows of a key apart; ``weight`` is
    what a row of the right side counts.

    A key is hot by its rows, or by the pairs it makes: two sides of modest size can make very many.
    Pairs are nothing that a shuffle sees, and AQE would merge small partitions that make long tasks.
    So they are counted first, by a job of its own that returns one row with the hot keys, and where
    they are many, both sides are dealt into as many partitions as the pairs need.
    """
    spark = left.sparkSession
    found = _pair_pieces(left, right, key, weight, tuning)
    total = found.agg(
        F.expr("coalesce(sum(pairs), 0D) AS pairs"),
        F.expr("collect_list(struct(hot_key, CAST(l AS INT) AS l, CAST(r AS INT) AS r)) FILTER (WHERE l * r > 1) AS hot"),
    )
    pairs, hot = total.first()
    if not hot and pairs <= tuning.hot_pairs * TASK_PIECES:
        return left.join(right, key)
    pieces = spark.createDataFrame(hot, total.schema["hot"].dataType.elementType)
    hot_left, hot_right = (pieces.selectExpr("hot_key", f"{n} AS pieces") for n in "lr")
    split_left = replicate_hot(
        spread_hot(left, key, hot_left, left_by, "__l"), key, hot_right, "__r"
    )
    split_right = replicate_hot(
        spread_hot(right, key, hot_right, right_by, "__r"), key, hot_left, "__l"
    )
    on = [key, "__l", "__r"]
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(pairs / tuning.hot_pairs / TASK_PIECES),
    )
    dealt = [df.repartition(tasks, *on) for df in (split_left, split_right)]
    return dealt[0].join(dealt[1], on).drop("__l", "__r")
