"""Tables laid out for the reports: by id for the catalog, by type for the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.sources.catalog import Catalog, checked_name, checked_prefix, table_names

#: Buckets of a catalog table; a power of two, so tables of different sizes still fit together.
BUCKETS = 64


def id_column(table: str) -> str:
    return "_id" if table == "domain_assets" else "id"


def save_catalog(
    spark: SparkSession, catalog: Catalog, schema: str | None = None, buckets: int = BUCKETS
) -> None:
    """Write each table of the catalog as a table bucketed and sorted by id.

    Reports over such tables, read with ``load_catalog``, join and gather by id where the rows lie.
    Rows are dealt by id first, so a bucket is one file. An existing table is replaced.
    """
    for name in table_names():
        table = getattr(catalog, name)
        if table is None:
            continue
        key = id_column(name)
        writer = table.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        writer.mode("overwrite").saveAsTable(checked_prefix(schema) + checked_name(name))


def save_events(
    spark: SparkSession, events: DataFrame, tenant: str, schema: str | None = None
) -> None:
    """Write a tenant's events, partitioned by their type, as the table ``load_events`` reads.

    Usage queries then read the partitions of their types alone. The rows are rebalanced by type, so
    rare types do not leave many small files and a frequent one is written by many tasks.
    """
    name = f"{checked_prefix(schema)}events_{checked_name(tenant)}"
    writer = events.hint("rebalance", "EVENT_TYPE").write.partitionBy("EVENT_TYPE")
    writer.mode("overwrite").saveAsTable(name)
