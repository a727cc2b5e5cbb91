import json

import pytest
from pyspark.sql import functions as F

from cartulary import Catalog, curated_dataset_report, merged_descriptions

NAMES = "governedTagIds_tag_names"


def description(anchor, text, actor="u1"):
    detail = {"type": "ASSET_DESCRIPTION", "assetDescription": {"description": text}}
    return {"anchorEntityId": anchor, "created": {"actor": actor}, "detail": detail}


@pytest.fixture
def catalog(build):
    def make(datasets, cards=()):
        other = ("zz", {"anchorEntityId": "other", "detail": {"type": "HOW_TO_USE"}})
        return Catalog.from_frames(
            datasets=build.datasets(*datasets),
            knowledge_cards=build.cards(other, *cards),
            users=build.users("u1", "u2", emails={"u1": "a@x"}),
            user_defined_resource=build.resources(T1="n1", T2="n2"),
        )

    return make


def texts(rows):
    return sorted(
        ([(d.description, d.source) for d in r.descriptions] if r.descriptions else None for r in rows),
        key=str,
    )


@pytest.mark.parametrize(
    "schema, cards, expected",
    [
        ({}, [], [None]),
        ({"description": ""}, [], [None]),
        ({"description": None}, [], [None]),
        ({"description": "own"}, [], [[("own", "P")]]),
        ({"description": ""}, [("c1", "told")], [[("told", "a@x")]]),
        (
            {"description": "own"},
            [("c1", "one"), ("c2", "two")],
            [[("own", "P"), ("one", "a@x")], [("own", "P"), ("two", "a@x")]],
        ),
        ({}, [("c1", None)], [None]),
        ({"description": "own"}, [("c1", None), ("c2", "two")],
         [[("own", "P")], [("own", "P"), ("two", "a@x")]]),
    ],
)
def test_merged_descriptions(catalog, tuning, schema, cards, expected):
    tables = catalog(
        [{"id": "d", "schema": schema}], [(c, description("d", text)) for c, text in cards]
    )
    assert texts(merged_descriptions(tables, tuning).collect()) == sorted(expected, key=str)


def test_author_without_email_or_unknown(catalog, tuning):
    tables = catalog(
        [{"id": "d"}], [("c1", description("d", "x", "u2")), ("c2", description("d", "y", "nobody"))]
    )
    assert texts(merged_descriptions(tables, tuning).collect()) == [[("x", None)], [("y", None)]]


def test_two_cards_and_two_tags(catalog, tuning):
    tables = catalog(
        [{"id": "d", "tags": ["T1", "T2"]}],
        [("c1", description("d", "one")), ("c2", description("d", "two"))],
    )
    rows = curated_dataset_report(tables, tag_name_copies="repeated", tuning=tuning).collect()
    assert len(rows) == 4
    assert all(sorted(r[NAMES]) == ["n1", "n1", "n2", "n2"] for r in rows)
    assert sorted(r.schema_description for r in rows) == sorted(
        json.dumps([{"description": t, "source": "a@x"}], separators=(",", ":"))
        for t in ("one", "one", "two", "two")
    )
    once = curated_dataset_report(tables, grain="asset", tag_name_copies="once", tuning=tuning).collect()
    assert len(once) == 2
    assert all(sorted(r[NAMES]) == ["n1", "n2"] and r.n_cards == 2 for r in once)


def test_copies_of_a_name_stand_together(catalog, tuning):
    cards = [(f"c{i}", description("d", f"text {i}")) for i in range(3)]
    tables = catalog([{"id": "d", "tags": ["T2", "T1"]}], cards)
    rows = curated_dataset_report(tables, tag_name_copies="repeated", tuning=tuning).collect()
    assert len(rows) == 6
    assert all(r[NAMES] == ["n1"] * 3 + ["n2"] * 3 for r in rows)


def test_names_as_one_text(catalog, tuning):
    """The text of all copies is that of the sorted array, and no array of the copies is made."""
    cards = [(f"c{i}", description("d", f"text {i}")) for i in range(3)]
    cards += [("e", description("one card", "x")), ("f", description("no tags", "x"))]
    tables = catalog(
        [{"id": "d", "tags": ["T2", "T1"]}, {"id": "one card", "tags": ["T2"]}, {"id": "no card", "tags": ["T1"]},
         {"id": "no tags"}, {"id": "unknown tag", "tags": ["T9"]}],
        cards,
    )
    for copies in ("repeated", "once"):
        arrays, joined = (
            curated_dataset_report(tables, tag_name_copies=copies, tuning=tuning, **more)
            for more in ({}, {"names_joined_by": "|"})
        )
        assert "array_repeat" not in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.columns == arrays.columns
        got = [r.asDict() for r in joined.collect()]
        want = [r.asDict() | {NAMES: "|".join(sorted(r[NAMES]))} for r in arrays.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {r["id"] for r in got if r[NAMES] == ""} == {"no tags", "unknown tag"}


def test_sorted_rows_stay_in_many_tasks(catalog, spark):
    """Rows are short when they are sorted and long when they are read: no task reads most of them."""
    tables = catalog([{"id": f"d{i:03}", "tags": ["T1"]} for i in range(200)])
    report = curated_dataset_report(tables, tag_name_copies="repeated")
    ids = [r.id for r in report.collect()]
    assert ids == sorted(ids)
    made = report.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and max(r["count"] for r in made) < 150


def test_only_production_datasets_with_fields(catalog, tuning):
    tables = catalog(
        [
            {"id": "kept"},
            {"id": "flagged", "flag": True},
            {"id": "unknown flag", "flag": None},
            {"id": "no fields", "schema": {"description": "x"}},
            {"id": "null fields", "schema": {"fields": None}},
        ]
    )
    assert [r.id for r in curated_dataset_report(tables, tuning=tuning).collect()] == ["kept"]


def test_descriptions_ascend_with_missing_last(catalog, tuning):
    tables = catalog(
        [{"id": i, "schema": {"fields": [], "description": d}}
         for i, d in (("1", None), ("2", "b"), ("3", "a"), ("4", ""))]
    )
    rows = curated_dataset_report(tables, tuning=tuning).collect()
    assert [r.id for r in rows] == ["3", "2", "1", "4"]


def test_bad_option(catalog):
    with pytest.raises(ValueError):
        curated_dataset_report(catalog([{"id": "d"}]), tag_name_copies="twice")
