"""Places, look-up checks and stored layouts."""

import pytest
from pyspark.sql import functions as F

import cartulary as c
from oracles.fixtures import derived_catalog, derived_events
from tests.conftest import SF_DIR


def test_places_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 611 AS k").repartition(7)
    rows = c.with_ordinals(df, [F.col("k").desc(), "id"], "at").collect()
    want = sorted(((r.id, r.k) for r in rows), key=lambda x: (-x[1], x[0]))
    assert [(r.id, r.k) for r in sorted(rows, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in rows) == list(range(1, 5001))
    one = c.with_ordinals(df.where("id = 3"), ["id"]).collect()
    assert [r.ordinal for r in one] == [1]
    assert c.with_ordinals(df.where("id < 0"), ["id"]).collect() == []


def test_sorting_does_not_use_one_task(spark):
    # Small partitions would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = c.with_ordinals(spark.range(4000).repartition(4), ["id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.rdd.getNumPartitions() > 1


def report(build, users, tuning):
    catalog = c.Catalog.from_frames(
        datasets=build.datasets({"id": "d", "tags": ["T1"], "followers": ["u1", "u2"]}),
        users=users,
        user_defined_resource=build.resources(T1="n1", T2="n2"),
    )
    return c.dataset_report(catalog, tuning=tuning)


@pytest.mark.parametrize("limit", [None, -1])
def test_repeated_keys_are_seen_while_joining(build, limit):
    users = build.users("u1", "u2", emails={"u1": "a@x", "u2": "b@x"})
    check = c.LookupCheck()
    watched = report(build, users, c.Tuning(broadcast_bytes=limit, lookups=check))
    plain = report(build, users, c.Tuning(broadcast_bytes=limit))
    assert watched.collect() == plain.collect()
    assert dict((k, (rows, keys)) for k, rows, keys in check.counts()) == {"resource_key": (2, 2), "user_key": (2, 2)}
    check.verify()

    twice = users.unionAll(users.where("id = 'u1'"))
    check = c.LookupCheck()
    (row,) = report(build, twice, c.Tuning(broadcast_bytes=limit, lookups=check)).collect()
    assert sorted(row.asset_followers_emails) == ["a@x", "a@x", "b@x"]
    with pytest.raises(ValueError, match="user_key: 3 rows, 2 keys"):
        check.verify()


def test_stored_tables_join_and_filter_where_rows_lie(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS laid_out")
    derived = derived_catalog(spark, SF_DIR, "datasets", "users", "user_defined_resource")
    c.save_catalog(spark, derived, "laid_out", buckets=4)
    c.save_events(spark, derived_events(spark, SF_DIR), "acme", "laid_out")
    catalog = c.load_catalog(spark, "laid_out")
    assert catalog.dashboards is None
    of = c.dataset_report(catalog)
    text = of._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in text and "Bucketed: true" in text
    assert of.count() == c.dataset_report(derived).count()
    events = c.load_events(spark, "acme", "laid_out")
    searched = c.popular_queries(events)
    text = searched._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "Search search attempted" in filters
    assert searched.collect() == c.popular_queries(derived_events(spark, SF_DIR)).collect()
