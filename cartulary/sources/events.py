"""Usage event tables, one per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.sources.catalog import checked_name, checked_prefix


def load_events(spark: SparkSession, tenant: str, schema: str | None = None) -> DataFrame:
    """The wide event table of a tenant, ``events_<tenant>``."""
    return spark.table(f"{checked_prefix(schema)}events_{checked_name(tenant)}")
