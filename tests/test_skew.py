"""Splitting hot keys changes the layout of a result and nothing else."""

import pytest
from pyspark.sql import functions as F

import cartulary as c
from cartulary import Tuning
from cartulary.operators.skew import (
    fan_out_join,
    hot_keys,
    key_counts,
    lookup_join,
    replicate_hot,
    spread_hot,
)
from oracles.fixtures import derived_catalog
from oracles.registry import comparable
from tests.conftest import SF_DIR

SPLIT = Tuning(broadcast_bytes=-1, hot_rows=3)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


REPORTS = {
    "datasets": lambda t, tuning: c.dataset_report(t, tuning=tuning),
    "dashboards": lambda t, tuning: c.dashboard_report(t, tuning=tuning),
    "cards": lambda t, tuning: c.knowledge_card_report(t, tuning=tuning),
    "users": lambda t, tuning: c.user_report(t, tuning=tuning),
    "curated": lambda t, tuning: c.curated_dataset_report(t, ordered=False, tuning=tuning),
    "top queries": lambda t, tuning: c.domain_top_queries(t, tuning=tuning),
    "domains": lambda t, tuning: c.domain_report(t, tuning=tuning),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_does_not_depend_on_the_layout(spark, name):
    tables = derived_catalog(spark, SF_DIR)
    make = REPORTS[name]
    assert rows(comparable(make(tables, SPLIT))) == rows(comparable(make(tables, Tuning())))


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key, some on NULL, the rest on many."""
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id % 50) END"
    return spark.range(3000).selectExpr("id", f"{key} AS key")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup(spark, skewed, how):
    lookup = spark.range(40).selectExpr("concat('k', id) AS lk", "id * 2 AS v").union(
        spark.sql("SELECT 'hot', -1L")
    )
    plain = skewed.join(lookup, F.col("key") == F.col("lk"), how).drop("lk")
    salted = lookup_join(skewed, lookup, "key", "lk", how, SPLIT)
    assert rows(salted) == rows(plain)
    with pytest.raises(ValueError):
        lookup_join(skewed, lookup, "key", "lk", "full")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_lookup_is_not_copied(spark, skewed):
    lookup = spark.sql("SELECT 'hot' AS lk, 1 AS v")
    text = optimized(lookup_join(skewed, lookup, "key", "lk", "inner", SPLIT))
    assert "explode" not in text.lower() and "strategy=broadcast" not in text
    assert "strategy=broadcast" in optimized(lookup_join(skewed, lookup, "key", "lk"))


def test_session_limit_holds_for_a_larger_tuning(spark, skewed):
    lookup = spark.range(10).selectExpr("concat('k', id) AS lk", "id AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = optimized(lookup_join(skewed, lookup, "key", "lk", tuning=Tuning(broadcast_bytes=1 << 30)))
        assert "strategy=broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_all_hot_keys_are_found(skewed):
    counts = key_counts(skewed, "key")
    got = {r.hot_key: r.pieces for r in hot_keys(counts, "key", tuning=Tuning(hot_rows=100)).collect()}
    assert got == {"hot": 10}
    assert counts.where("key IS NULL").count() == 0
    every = hot_keys(counts, "key", tuning=Tuning(hot_rows=1))
    assert every.count() == counts.count()


def test_hot_rows_are_cut_into_pieces(skewed):
    tuning = Tuning(hot_rows=125)
    hot = hot_keys(key_counts(skewed, "key"), "key", tuning=tuning)
    spread = spread_hot(skewed, "key", hot, ["id"])
    sizes = {(r.key, r.salt): r["count"] for r in spread.groupBy("key", "salt").count().collect()}
    pieces = [n for (key, _), n in sizes.items() if key == "hot"]
    assert len(pieces) == 8 and sum(pieces) == 1000 and max(pieces) < 250
    assert all(salt == 0 for key, salt in sizes if key != "hot")
    repeated = replicate_hot(skewed.select("key").distinct(), "key", hot)
    copies = {r.key: r["count"] for r in repeated.groupBy("key").count().collect()}
    assert copies["hot"] == 8 and set(copies.values()) == {1, 8}


def test_fan_out_with_both_sides_hot(spark, skewed):
    right = spark.range(60).selectExpr("id AS rid", "CASE WHEN id < 30 THEN 'hot' ELSE concat('k', id) END AS key")
    plain = skewed.join(right, "key")
    split = fan_out_join(skewed, right, "key", ["id"], ["rid"], tuning=Tuning(hot_rows=10))
    assert rows(split) == rows(plain)


def test_pairs_of_a_key_are_split(spark):
    """Two short sides of one key make many rows, which go to many tasks."""
    left = spark.range(300).selectExpr("id", "'k' AS key")
    right = spark.range(200).selectExpr("id AS rid", "'k' AS key").unionAll(spark.sql("SELECT 1L, NULL"))
    joined = fan_out_join(left, right, "key", ["id"], ["rid"], tuning=Tuning(hot_pairs=1000))
    assert joined.distinct().count() == joined.count() == 60_000
    made = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(made) > 4 and max(r["count"] for r in made) < 30_000
    weighed = fan_out_join(left, right, "key", ["id"], ["rid"], "rid", Tuning(hot_pairs=1000))
    assert rows(weighed) == rows(left.join(right, "key"))
