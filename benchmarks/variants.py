"""

``python -m benchmarks.variants [copies] [text]`` runs the variants whose name has the text.
The datasets are stored ``copies`` times over, with distinct ids, so that the data and not the
start of the jobs is measured.
"""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import bench
import cartulary as c
from cartulary.functions.jsonx import read_fields
from cartulary.operators import refs
from cartulary.plans.entities import DATASETS
from cartulary.semantics import PRESTO
from oracles.fixtures import derived_catalog, derived_events

# Not the cards: the exact curated report repeats tag names per card on every row of a card,
# so its size grows with the square of the cards per dataset.
COPIED = ("datasets",)


def store(spark, root: str, copies: int) -> c.Catalog:
    derived = derived_catalog(spark, bench.SF_DIR)
    parts = spark.sparkContext.defaultParallelism * 2
    for name in vars(derived):
        table = getattr(derived, name)
        if name in COPIED and copies > 1:
            numbered = table.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
            table = numbered.withColumn("id", F.expr("concat(id, IF(copy = 0, '', concat('-', copy)))"))
            table = table.drop("copy").repartition(parts, "id")
        table.write.parquet(f"{root}/{name}")
    return c.load_catalog_files(spark, root)


def window_form(t: c.Catalog) -> DataFrame:
    named = refs.resolve_tags(refs.tag_ids(t.datasets), t.user_defined_resource)
    joined = t.datasets.select("id").join(
        named.select(F.col("id").alias("d_id"), "tag_name"), F.expr("id = d_id"), "left"
    )
    return joined.select("id", F.collect_list("tag_name").over(Window.partitionBy("d_id")).alias("n"))


def aggregated_form(t: c.Catalog) -> DataFrame:
    names = refs.tag_names(t.datasets, t.user_defined_resource)
    joined = t.datasets.select("id").join(names, "id", "left")
    return c.operators.grain.apply_grain(joined, "asset_tag")


def fields_by_path(t: c.Catalog) -> DataFrame:
    return t.datasets.select("id", *(
        F.get_json_object(f.doc, f"$.{f.path}").alias(f.column) for f in DATASETS.fields
    ))


def recursive_details(t: c.Catalog) -> DataFrame:
    t.domain_assets.createOrReplaceTempView("domain_assets_view")
    return t.domain_assets.sparkSession.sql("""
        WITH RECURSIVE walk(id, parent, assets) AS (
            SELECT _id, parent, concat(live_query_assets, selected_assets) FROM domain_assets_view
            UNION ALL
            SELECT d._id, d.parent, concat(d.live_query_assets, d.selected_assets)
            FROM domain_assets_view d JOIN walk w ON w.id = d.parent
        )
        SELECT DISTINCT id, parent, asset FROM walk LATERAL VIEW explode(assets) AS asset
    """)


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 1
    spark = bench.session()
    t = store(spark, tempfile.mkdtemp(prefix="variants-") + "/catalog", copies)
    events = derived_events(spark, bench.SF_DIR)
    shuffled = c.Tuning(broadcast_bytes=-1)
    variants = {
        "tag names: literal window": lambda: window_form(t),
        "tag names: aggregate, then join": lambda: aggregated_form(t),
        "dataset fields: one path call per field": lambda: fields_by_path(t),
        "dataset fields: one from_json per document": lambda: read_fields(t.datasets, ["id"], DATASETS.fields),
        "dataset fields: variant per document": lambda: read_fields(t.datasets, ["id"], DATASETS.fields, PRESTO),
        "dataset report: broadcast lookups": lambda: c.dataset_report(t),
        "dataset report: salted shuffle lookups": lambda: c.dataset_report(t, tuning=shuffled),
        "dataset report: asset grain": lambda: c.dataset_report(t, grain="asset"),
        "curated report: exact grain, sorted": lambda: c.curated_dataset_report(t),
        "curated report: exact grain, unsorted": lambda: c.curated_dataset_report(t, ordered=False),
        "curated report: asset grain, names once": lambda: c.curated_dataset_report(
            t, grain="asset", ordered=False, tag_name_copies="once"
        ),
        "domain asset details: recursive": lambda: recursive_details(t),
        "domain asset details: flat": lambda: c.domain_asset_details(t.domain_assets, t.namespaces),
        "popular queries: full sort": lambda: c.popular_queries(events),
        "popular queries: top 10": lambda: c.popular_queries(events, top=10),
    }
    chosen = sys.argv[2] if len(sys.argv) > 2 else ""
    for name, make in variants.items():
        if chosen not in name:
            continue
        print(f"| {name} | {bench.median_seconds(make):.2f} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
