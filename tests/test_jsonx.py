import pytest
from pyspark.sql import functions as F

from cartulary.functions.jsonx import (
    VALUE,
    Field,
    document_schema,
    may_mention,
    read_fields,
    read_for_filter,
    text_array,
    text_at,
)
from cartulary.semantics import PRESTO

DOCS = [
    ("object", '{"a": {"b": "x"}, "c": [1, "y", {"k": 2}], "d": "t"}'),
    ("null field", '{"a": {"b": null}, "d": null}'),
    ("number", '{"a": {"b": 7}, "d": 12345678901}'),
    ("container", '{"a": {"b": {"z": [1, 2]}}, "d": [1, {"q": "r"}]}'),
    ("malformed", '{"a": {"b": "x"'),
    ("not an object", "[1]"),
    ("missing", None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, doc string")


def values(df):
    return {row[0]: tuple(row)[1:] for row in df.collect()}


FIELDS = [Field("b", "doc", "a.b"), Field("d", "doc", "d", VALUE)]


def test_fields_as_text(docs):
    assert values(read_fields(docs, ["id"], FIELDS)) == {
        "object": ("x", "t"),
        "null field": (None, None),
        "number": ("7", "12345678901"),
        "container": ('{"z":[1,2]}', '[1,{"q":"r"}]'),
        "malformed": (None, None),
        "not an object": (None, None),
        "missing": (None, None),
    }


def test_one_field_reads_like_many(docs):
    one = values(read_fields(docs, ["id"], FIELDS[:1]))
    many = values(read_fields(docs, ["id"], FIELDS))
    assert {k: v[0] for k, v in many.items()} == {k: v[0] for k, v in one.items()}
    assert values(read_for_filter(docs, ["id"], FIELDS)) == many


def test_quoted_fields(docs):
    got = values(read_fields(docs, ["id"], FIELDS, PRESTO))
    assert got["object"] == ("x", '"t"')
    assert got["number"] == ("7", "12345678901")
    assert got["container"] == (None, '[1,{"q":"r"}]')
    assert got["null field"] == (None, None)
    assert got["malformed"] == (None, None)


def test_array_elements_as_text(docs):
    got = values(docs.selectExpr("id", f"{text_array(docs, 'doc', 'c')} AS c"))
    assert got["object"] == (["1", "y", '{"k":2}'],)
    assert got["container"] == (None,)
    assert got["malformed"] == (None,)


def test_array_index_in_path(spark):
    df = spark.createDataFrame(
        [(1, '{"e":[{"x":"first"},{"x":"second"}]}'), (2, '{"e":[]}'), (3, "{}")], "id int, doc string"
    )
    fields = [Field("x", "doc", "e[0].x"), Field("y", "doc", "y")]
    assert values(read_fields(df, ["id"], fields)) == {1: ("first", None), 2: (None, None), 3: (None, None)}
    assert [r[0] for r in df.selectExpr(text_at(df, "doc", "e[1].x")).collect()] == ["second", None, None]


def test_schema_is_merged_and_checked():
    schema = document_schema(["detail.type", "detail.query.title", "id"])
    assert schema == "`detail` STRUCT<`type`: STRING, `query`: STRUCT<`title`: STRING>>, `id` STRING"
    with pytest.raises(ValueError):
        document_schema(["detail", "detail.type"])
    with pytest.raises(ValueError):
        document_schema(["e[0].x", "e.y"])


def test_filter_does_not_repeat_the_parse(docs):
    filtered = read_for_filter(docs, ["id"], FIELDS).where("b = 'x' AND d = 't'")
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [r.id for r in filtered.collect()] == ["object"]


def test_may_mention_keeps_escaped_words(spark):
    df = spark.createDataFrame(
        [(1, '{"t":"QUERY"}'), (2, '{"t":"\\u0051UERY"}'), (3, '{"t":"OTHER"}')], "id int, doc string"
    )
    kept = {r.id for r in df.where(may_mention(df, "doc", "QUERY")).collect()}
    assert kept == {1, 2}
    exact = df.where(F.get_json_object("doc", "$.t") == "QUERY")
    assert {r.id for r in exact.collect()} <= kept
