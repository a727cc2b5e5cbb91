import pytest

from cartulary import (
    Catalog,
    dataset_report,
    duplicate_ids,
    load_catalog,
    load_catalog_files,
    load_table,
    normalize_catalog,
    user_report,
)
from cartulary.sources.catalog import table_names
from oracles.fixtures import derived_catalog
from tests.conftest import SF_DIR


def test_old_names_become_the_common_ones(spark):
    df = spark.sql("SELECT 'd' AS id, now() AS created_at, '{}' AS upstream, '{}' AS schema")
    assert normalize_catalog(df, "datasets").columns == ["id", "_created_at", "entity_upstream", "schema"]
    both = spark.sql("SELECT 1 AS created_at, 2 AS _created_at")
    assert normalize_catalog(both, "users").columns == ["created_at", "_created_at"]
    with pytest.raises(ValueError, match="unknown catalog table"):
        normalize_catalog(df, "tables")


@pytest.mark.parametrize(
    "column",
    ["'{text}'", "parse_json('{text}')", "from_json('{text}', 'governedTagIds array<string>')"],
)
def test_documents_may_be_text_variant_or_nested(spark, build, column):
    text = '{"governedTagIds":["T1","T2"]}'
    datasets = build.datasets({"id": "d"}).drop("asset_governed_tags").selectExpr(
        "*", column.replace("{text}", text) + " AS asset_governed_tags"
    )
    catalog = Catalog.from_frames(
        datasets=datasets, users=build.users("u"), user_defined_resource=build.resources(T1="n1", T2="n2")
    )
    rows = dataset_report(catalog).collect()
    assert len(rows) == 2
    assert rows[0].asset_governed_tags_governedTagIds == '["T1","T2"]'
    assert sorted(rows[0].governedTagIds_tag_names) == ["n1", "n2"]


def test_missing_table_is_named(build):
    with pytest.raises(ValueError, match="users"):
        dataset_report(Catalog.from_frames(datasets=build.datasets({"id": "d"}), user_defined_resource=build.resources(T="n")))


def test_tables_from_a_schema_and_from_files(spark, tmp_path):
    derived = derived_catalog(spark, SF_DIR)
    spark.sql("CREATE SCHEMA IF NOT EXISTS meta")
    for name in table_names():
        getattr(derived, name).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        if name in ("datasets", "users", "user_defined_resource"):
            getattr(derived, name).write.mode("overwrite").saveAsTable(f"meta.{name}")
    expected = dataset_report(derived).count()
    from_schema = load_catalog(spark, "meta")
    assert from_schema.dashboards is None
    assert dataset_report(from_schema).count() == expected
    assert dataset_report(load_catalog_files(spark, str(tmp_path))).count() == expected
    assert load_table(spark, "users", "meta").count() == derived.users.count()
    with pytest.raises(ValueError):
        load_table(spark, "users", "meta; drop")


def test_upper_case_tables_keep_every_column(build):
    users = build.users("u1", "u2", emails={"u1": "a@x"})
    upper = users.toDF(*(name.upper() for name in users.columns))
    plain, shouted = (user_report(Catalog.from_frames(users=u)) for u in (users, upper))
    assert plain.columns == shouted.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, shouted.collect()))


def test_absent_documents_are_named_unless_optional(build):
    tables = {"users": build.users("u"), "user_defined_resource": build.resources(T="n")}
    datasets = build.datasets({"id": "d"})
    assert dataset_report(Catalog.from_frames(datasets=datasets.drop("structure"), **tables)).count() == 1
    with pytest.raises(ValueError, match="statistics"):
        dataset_report(Catalog.from_frames(datasets=datasets.drop("statistics"), **tables))


@pytest.mark.parametrize("wrap", ["to_json({})", "parse_json(to_json({}))"])
def test_asset_lists_may_be_text_or_variant(build, wrap):
    assets = build.domain_assets(("x", None, ["D1", "D2"], ["D3"]))
    lists = ["live_query_assets", "selected_assets"]
    other = assets.selectExpr("_id", "parent", *(f"{wrap.format(x)} AS {x}" for x in lists))
    assert normalize_catalog(other, "domain_assets").collect() == assets.select(*other.columns).collect()


def test_dotted_schema_and_chosen_files(spark, build, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS dotted")
    users = build.users("u1", "u2")
    users.write.mode("overwrite").saveAsTable("dotted.users")
    assert load_table(spark, "users", "spark_catalog.dotted").count() == 2
    with pytest.raises(ValueError):
        load_table(spark, "users", "spark_catalog.dot-ted")
    users.write.parquet(f"{tmp_path}/users")
    assert load_catalog_files(spark, str(tmp_path), tables=["users"]).users.count() == 2


def test_repeated_ids_are_counted(build):
    users = build.users("u1", "u2")
    assert duplicate_ids(users).isEmpty()
    assert [tuple(r) for r in duplicate_ids(users.union(users.limit(1))).collect()] == [("u1", 2)]
