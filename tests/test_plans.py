"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import cartulary as c
from cartulary import Tuning
from cartulary.operators import refs
from cartulary.sources.catalog import DOCUMENT_COLUMNS, table_names
from oracles.fixtures import derived_catalog
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalog"))
    derived = derived_catalog(spark, SF_DIR)
    for name in table_names():
        getattr(derived, name).write.parquet(f"{root}/{name}")
    return c.load_catalog_files(spark, root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


REPORTS = {
    "datasets": c.dataset_report,
    "dashboards": c.dashboard_report,
    "views": c.virtual_view_report,
    "cards": c.knowledge_card_report,
    "users": c.user_report,
    "curated": c.curated_dataset_report,
    "asset names": c.domain_asset_names,
    "top queries": c.domain_top_queries,
    "domains": c.domain_report,
}


@pytest.mark.parametrize("layout", [Tuning(), Tuning(broadcast_bytes=-1)])
@pytest.mark.parametrize("name", REPORTS)
def test_no_window_python_or_cross_join(stored, name, layout):
    text = plan(REPORTS[name](stored, tuning=layout))
    for banned in ("Window", "Python", "Cartesian", "NestedLoop", "BatchEval"):
        assert banned not in text


def test_entity_scan_reads_only_its_columns(stored):
    text = plan(refs.tag_names(stored.datasets, stored.user_defined_resource))
    assert "struct<id:string,asset_governed_tags:string>" in text
    assert "logical_id" not in text


DOCUMENTS = DOCUMENT_COLUMNS["datasets"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parses(text, document):
    """How often a plan parses a document: the column is named after the schema and the options."""
    return len(re.findall(rf"from_json\([^#]*?\b{document}#\d+", text))


def test_each_document_is_parsed_once(stored):
    text = optimized(c.dataset_report(stored))
    # Users have a document of one of these names too.
    once = dict.fromkeys(DOCUMENTS, 1) | {"logical_id": 2}
    assert {name: parses(text, name) for name in DOCUMENTS} == once
    assert "get_json_object" not in text


def test_curated_report_parses_each_document_once(stored):
    text = optimized(c.curated_dataset_report(stored))
    documents = set(DOCUMENTS) - {"custom_metadata", "logical_id"}
    assert {name: parses(text, name) for name in documents} == dict.fromkeys(documents, 1)


def test_references_are_one_read_and_one_exchange(stored):
    text = plan(c.dataset_report(stored, grain="asset"))
    assert len(re.findall(r"FileScan parquet[^\n]*/datasets\]", text)) == 2
    # The own columns and the gathered references, each by id.
    assert len(re.findall(r"hashpartitioning\(id#", text)) == 2
    assert text.count("FileScan parquet") == 4


def test_variants_are_read_in_place(stored):
    documents = {n: F.parse_json(F.col(n)) for n in DOCUMENTS}
    tables = c.Catalog.from_frames(
        datasets=stored.datasets.withColumns(documents),
        users=stored.users,
        user_defined_resource=stored.user_defined_resource,
    )
    text = optimized(c.dataset_report(tables))
    assert "to_json" not in text
    assert all(parses(text, name) == 0 for name in DOCUMENTS if name != "logical_id")


def test_assets_are_named_in_one_exchange(stored):
    listed = stored.domain_assets.selectExpr("explode(selected_assets) AS asset")
    assert plan(c.plans.domains.asset_names(listed, stored)).count("Exchange hash") == 1


def test_filters_reach_the_scan(stored):
    text = plan(c.curated_dataset_report(stored))
    assert "Not(EqualTo(is_non_prod,true))" in text
    assert "IsNull(deleted_at)" in plan(c.domain_top_queries(stored))
    assert "IsNull(deleted_at)" in plan(c.domain_report(stored))


def test_window_form_gives_the_same_rows(stored):
    """The literal form: join the tags, then collect over a window on their entity."""
    named = refs.resolve_tags(refs.tag_ids(stored.datasets), stored.user_defined_resource)
    joined = stored.datasets.select("id").join(
        named.select(F.col("id").alias("d_id"), "tag_name"), F.expr("id = d_id"), "left"
    )
    over = Window.partitionBy("d_id")
    window = joined.select("id", F.sort_array(F.collect_list("tag_name").over(over)).alias("n"))
    ours = c.dataset_report(stored).select("id", F.sort_array("governedTagIds_tag_names").alias("n"))
    assert sorted(map(tuple, window.collect())) == sorted(map(tuple, ours.collect()))


def test_asset_grain_is_the_distinct_of_tag_grain(stored):
    columns = ["id", "governedTagIds_tag_names"]
    by_tag = c.dataset_report(stored).select(*columns).distinct()
    by_asset = c.dataset_report(stored, grain="asset").select(*columns)
    sort = F.sort_array("governedTagIds_tag_names").alias("n")
    assert sorted(map(tuple, by_tag.select("id", sort).distinct().collect())) == sorted(
        map(tuple, by_asset.select("id", sort).collect())
    )
