import json

import pytest

from cartulary import Catalog, Semantics, dataset_report, user_report
from cartulary.operators import refs
from cartulary.operators.skew import fits_broadcast
from cartulary.semantics import PRESTO, Tuning

NAMES = "governedTagIds_tag_names"


@pytest.fixture
def lookups(build):
    return {
        "users": build.users("u1", "u2", "u3", emails={"u1": "a@x", "u2": "b@x"}),
        "user_defined_resource": build.resources(T1="n1", T2="n2", T3=None),
    }


def report(build, lookups, row, tuning, **options):
    catalog = Catalog.from_frames(datasets=build.datasets({"id": "d", **row}), **lookups)
    return dataset_report(catalog, tuning=tuning, **options).collect()


@pytest.mark.parametrize(
    "row, rows, names",
    [
        ({"raw_tags": None}, 1, []),
        ({"raw_tags": "{}"}, 1, []),
        ({"tags": []}, 1, []),
        ({"tags": ["T1"]}, 1, ["n1"]),
        ({"tags": ["T1", "T2"]}, 2, ["n1", "n2"]),
        ({"tags": ["T1", "T1"]}, 2, ["n1", "n1"]),
        ({"tags": ["NOPE"]}, 1, []),
        ({"tags": ["T3"]}, 1, []),
        ({"tags": ["T3", "T1"]}, 2, ["n1"]),
        ({"raw_tags": "{broken"}, 1, []),
        ({"raw_tags": '{"governedTagIds":"T1"}'}, 1, []),
    ],
)
def test_tag_rows(build, lookups, tuning, row, rows, names):
    got = report(build, lookups, row, tuning)
    assert len(got) == rows
    assert all(sorted(r[NAMES]) == names for r in got)
    (one,) = report(build, lookups, row, tuning, grain="asset")
    assert sorted(one[NAMES]) == names


def test_unknown_grain(build, lookups):
    with pytest.raises(ValueError, match="grain"):
        report(build, lookups, {}, Tuning(), grain="tag")


@pytest.mark.parametrize(
    "followers, emails",
    [(None, None), ([], None), (["nobody"], None), (["u1", "u1", "u2"], ["a@x", "a@x", "b@x"]),
     (["u3"], []), (["u3", "u1"], ["a@x"])],
)
def test_follower_emails(build, lookups, tuning, followers, emails):
    (row,) = report(build, lookups, {"followers": followers}, tuning)
    got = row.asset_followers_emails
    assert (got if got is None else sorted(got)) == emails


@pytest.mark.parametrize(
    "contact, expected",
    [
        ({"designation": "T1", "value": "u1"}, [("a@x", "n1")]),
        (json.dumps({"designation": "T1", "value": "u1"}), [("a@x", "n1")]),
        ({"designation": "T1", "value": "nobody"}, None),
        ({"designation": "NOPE", "value": "u1"}, None),
        ({"designation": "T3", "value": "u3"}, [(None, None)]),
        ({"value": "u1"}, None),
    ],
)
def test_contacts(build, lookups, tuning, contact, expected):
    (row,) = report(build, lookups, {"contacts": [contact]}, tuning)
    info = row.asset_contacts_info
    assert (info if info is None else [tuple(i) for i in info]) == expected


def test_kept_nulls_and_quotes(build, lookups, tuning):
    row = {
        "tags": ["T3", "T1"], "followers": ["u3", "u1"],
        "contacts": [{"designation": "T3", "value": "u1"}],
        "schema": {"description": {"no": "scalar"}, "entityId": "E", "fields": ["f"]},
    }
    got = report(build, lookups, row, tuning, semantics=PRESTO)
    assert len(got) == 2
    one = got[0]
    assert sorted(one[NAMES], key=str) == [None, "n1"]
    assert sorted(one.asset_followers_emails, key=str) == [None, "a@x"]
    assert one.asset_contacts_info == ['{"email":"a@x","designation":null}']
    assert (one.schema_description, one.schema_entityId, one.schema_fields) == (None, "E", '["f"]')
    (untagged,) = report(build, lookups, {}, tuning, semantics=Semantics(keep_null_elements=True))
    assert untagged[NAMES] == [None]


def test_search_keywords(spark, build):
    users = build.users("u1", "u2", "u3", "u4").drop("activity")
    activity = spark.createDataFrame(
        [
            ("u1", '{"recentSearches":[{"keyword":"k"},{"other":1},{"keyword":"k"}]}'),
            ("u2", '{"recentSearches":[]}'),
            ("u3", '{"recentSearches":[{"other":1}]}'),
            ("u4", None),
        ],
        "id string, activity string",
    )
    catalog = Catalog.from_frames(users=users.join(activity, "id"))
    got = {r.id: r.recent_searches_keywords for r in user_report(catalog).collect()}
    assert got == {"u1": ["k", "k"], "u2": None, "u3": [], "u4": None}
    kept = {r.id: r.recent_searches_keywords for r in user_report(catalog, PRESTO).collect()}
    assert kept["u1"] == ["k", None, "k"]
    long = refs.search_keywords(catalog.users)
    assert sorted(map(tuple, long.collect()), key=str) == sorted(
        [("u1", "k"), ("u1", None), ("u1", "k"), ("u3", None)], key=str
    )


def test_lookup_limit_follows_the_session(spark, tmp_path):
    path = str(tmp_path / "lookup")
    spark.range(1000).selectExpr("id", "repeat('x', 100) AS text").write.parquet(path)
    lookup = spark.read.parquet(path)
    assert fits_broadcast(lookup)
    assert not fits_broadcast(lookup, Tuning(broadcast_bytes=10))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for text, fits in (("1k", False), ("10MB", True), ("-1", False)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert fits_broadcast(lookup) == fits
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
