import pytest

from cartulary import (
    event_properties,
    event_type_properties,
    load_events,
    popular_queries,
    popularity,
    sample_events,
    saved_searches,
)
from cartulary.plans.event_catalog import (
    event_dictionary,
    event_properties_by_type,
    known_type,
)

SEARCH = "Search search attempted"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (SEARCH, "a", "x@x", "h1"), (SEARCH, "b", "x@x", None), (SEARCH, "a", "y@x", None),
        (SEARCH, None, None, None), (SEARCH, None, "x@x", None), (SEARCH, "c", "x@x", None),
        ("PageViewEvent home_page", "p", "x@x", "top"), ("PageViewEvent search_page", "q", "y@x", None),
        ("General sign_in attempted", None, "x@x", None), ("Unlisted thing", None, None, None),
    ]
    df = spark.createDataFrame(rows, "event_type string, query string, email string, hash string")
    return df.selectExpr("*", "'d' AS deployeddomain", "'full' AS pagetype", "'p' AS page", "'e' AS eventtype")


def test_dictionary_is_complete(spark):
    table = event_properties_by_type()
    assert len(table) == 93
    assert sum(map(len, table.values())) == 173
    assert len({name for names in table.values() for name in names}) == 70
    rows = event_dictionary(spark).collect()
    assert len(rows) == 173 + sum(1 for names in table.values() if not names)
    names = {r.property: r.column_name for r in rows}
    assert names["facetsJSON"] == "FACETSJSON" and names["identity_provider"] == "IDENTITY_PROVIDER"


def test_popularity_counts_missing_values(events):
    got = [tuple(r) for r in popular_queries(events).collect()]
    assert got == [(None, 2), ("a", 2), ("b", 1), ("c", 1)]
    assert popular_queries(events).columns == ["QUERY", "COUNT"]
    assert sum(n for _, n in got) == events.where(f"event_type = '{SEARCH}'").count()
    assert [tuple(r) for r in popular_queries(events, top=1).collect()] == [(None, 2)]


def test_template_type_matches_by_prefix(events):
    page = "PageViewEvent [page name]"
    assert {tuple(r) for r in event_properties(events, page).collect()} == {("top", "p"), (None, "q")}
    one = event_properties(events, "PageViewEvent home_page", envelope=True)
    assert one.columns == ["EVENTTYPE", "DEPLOYEDDOMAIN", "PAGETYPE", "PAGE", "HASH", "QUERY"]
    assert one.count() == 1
    assert [tuple(r) for r in popularity(events, page, "email").collect()] == [("x@x", 1), ("y@x", 1)]


def test_unknown_type_is_named_in_the_error(events):
    assert known_type("PageViewEvent x") == "PageViewEvent [page name]"
    with pytest.raises(ValueError, match="General sign_in attempted"):
        event_properties(events, "General sign_in atempted")
    with pytest.raises(ValueError, match="no properties"):
        event_properties(events, "Engagement app installed")


def test_every_type_can_be_selected(spark):
    columns = {n.lower() for names in event_properties_by_type().values() for n in names}
    wide = spark.range(1).selectExpr("'t' AS event_type", *(f"'v' AS `{c}`" for c in sorted(columns)))
    for event_type, names in event_properties_by_type().items():
        if names:
            assert event_properties(wide, event_type).columns == [n.upper() for n in names]


def test_properties_of_the_types_that_occur(events):
    got = {(r.EVENT_TYPE, r.EVENTS, r.PROPERTY) for r in event_type_properties(events).collect()}
    assert ("PageViewEvent home_page", 1, "hash") in got
    assert ("General sign_in attempted", 1, "identity_provider") in got
    assert ("Unlisted thing", 1, None) in got
    assert len([g for g in got if g[0] == SEARCH]) == 7


def test_sample_and_tenant_tables(spark, events):
    assert sample_events(events).count() == 5
    events.createOrReplaceTempView("events_acme")
    assert load_events(spark, "acme").count() == events.count()
    for bad in ("acme; drop", "a.b", "", "a`b"):
        with pytest.raises(ValueError):
            load_events(spark, bad)


def test_filter_and_columns_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.selectExpr("*", "email AS name", "query AS keyword", "hash AS context", "hash AS facetsjson").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = popular_queries(stored)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(event_type,{SEARCH})" in plan
    assert "ReadSchema: struct<event_type:string,query:string>" in plan
    assert "partial_count" in plan
    top = popular_queries(stored, top=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
    saved = saved_searches(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in saved and "query" not in saved.split("ReadSchema")[1]


def test_counts_run_unchanged_on_a_stream(spark, events, tmp_path):
    path = str(tmp_path / "stream")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    query = (
        popular_queries(stream).writeStream.outputMode("complete")
        .format("memory").queryName("popular").start()
    )
    query.processAllAvailable()
    query.stop()
    got = [tuple(r) for r in spark.table("popular").collect()]
    assert got == [tuple(r) for r in popular_queries(events).collect()]
