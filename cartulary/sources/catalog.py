"""Catalog tables: loading them and bringing them to one shape."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.jsonx import elements, quote

# The JSON document columns of each catalog table.
DOCUMENT_COLUMNS = {
    "datasets": (
        "logical_id", "schema", "structure", "statistics", "source_info", "entity_upstream",
        "asset_followers", "asset_contacts", "asset_governed_tags", "custom_metadata",
    ),
    "dashboards": (
        "source_info", "logical_id", "entity_upstream", "dashboard_info", "structure",
        "asset_followers", "asset_contacts", "asset_governed_tags",
    ),
    "virtual_views": (
        "logical_id", "structure", "asset_followers", "asset_contacts", "asset_governed_tags",
    ),
    "knowledge_cards": (
        "knowledge_card_info", "asset_followers", "asset_contacts", "asset_governed_tags",
    ),
    "users": ("logical_id", "properties", "activity", "asset_followers"),
    "user_defined_resource": ("user_defined_resource_info",),
    "namespaces": (
        "namespace_info", "namespace_assets", "asset_followers", "asset_contacts",
        "asset_governed_tags",
    ),
    "domain_assets": (),
}

# Spellings of a column that mean another one.
COLUMN_SYNONYMS = {"created_at": "_created_at", "upstream": "entity_upstream"}

# Columns that hold lists of asset ids.
LIST_COLUMNS = {"domain_assets": ("live_query_assets", "selected_assets")}

# Documents that an export may lack; any other one is required where it is read.
OPTIONAL_DOCUMENTS = {
    "datasets": ("structure", "custom_metadata"),
    "dashboards": ("structure",),
    "virtual_views": ("structure",),
    "users": ("asset_followers",),
}

_NAME = re.compile(r"[A-Za-z0-9_]+")


def checked_name(name: str) -> str:
    """A table, schema or tenant name that is safe to put into an identifier."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def checked_prefix(schema: str | None) -> str:
    """``schema`` or ``catalog.schema``, each part checked, with a dot after it."""
    if schema is None:
        return ""
    return "".join(f"{checked_name(part)}." for part in schema.split("."))


def normalize_catalog(df: DataFrame, kind: str) -> DataFrame:
    """Unify column names in lower case, and give every document column as text or a variant.

    Text and variants stay as they are; a nested column becomes a variant. A column that holds a list
    of ids may come in each of these forms and becomes an array of strings.
    """
    if kind not in DOCUMENT_COLUMNS:
        raise ValueError(f"unknown catalog table {kind!r}; known: {sorted(DOCUMENT_COLUMNS)}")
    df = df.toDF(*(name.lower() for name in df.columns))
    present = {name: name for name in df.columns}
    renames = {
        present[old]: new
        for old, new in COLUMN_SYNONYMS.items()
        if old in present and new not in present
    }
    df = df.withColumnsRenamed(renames)
    types = {field.name.lower(): field for field in df.schema.fields}
    shaped = {}
    for name in DOCUMENT_COLUMNS[kind]:
        field = types.get(name)
        if field is None or isinstance(field.dataType, (T.StringType, T.VariantType)):
            continue
        shaped[field.name] = F.to_variant_object(F.col(field.name))
    for name in LIST_COLUMNS.get(kind, ()):
        field = types.get(name)
        if field is None or field.dataType == T.ArrayType(T.StringType()):
            continue
        shaped[field.name] = F.expr(_id_list(quote(field.name), field.dataType))
    return df.withColumns(shaped) if shaped else df


def _id_list(column: str, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return elements(column)
    if isinstance(kind, T.VariantType):
        return f"try_variant_get({column}, '$', 'array<string>')"
    return f"CAST({column} AS ARRAY<STRING>)"


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """``key, n_rows`` of ids that occur more than once; the reports take ids to be unique."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where("n_rows > 1")


@dataclass(frozen=True)
class Catalog:
    """The catalog tables a report may need, each already normalized."""

    datasets: DataFrame | None = None
    dashboards: DataFrame | None = None
    virtual_views: DataFrame | None = None
    knowledge_cards: DataFrame | None = None
    users: DataFrame | None = None
    user_defined_resource: DataFrame | None = None
    namespaces: DataFrame | None = None
    domain_assets: DataFrame | None = None

    def require(self, *names: str) -> list[DataFrame]:
        missing = [name for name in names if getattr(self, name) is None]
        if missing:
            raise ValueError(f"the catalog has no table {', '.join(missing)}")
        return [getattr(self, name) for name in names]

    @classmethod
    def from_frames(cls, **tables: DataFrame) -> Catalog:
        return cls(**{name: normalize_catalog(df, name) for name, df in tables.items()})


def table_names() -> list[str]:
    return [field.name for field in fields(Catalog)]


def load_table(spark: SparkSession, kind: str, schema: str | None = None) -> DataFrame:
    """One catalog table by name, from the current schema, ``schema`` or ``catalog.schema``."""
    return normalize_catalog(spark.table(checked_prefix(schema) + checked_name(kind)), kind)


def load_catalog(spark: SparkSession, schema: str | None = None) -> Catalog:
    """All catalog tables that exist in the schema."""
    prefix = checked_prefix(schema)
    found = [name for name in table_names() if spark.catalog.tableExists(prefix + name)]
    return Catalog(**{name: load_table(spark, name, schema) for name in found})


def load_catalog_files(
    spark: SparkSession, root: str, file_format: str = "parquet", tables: Sequence[str] | None = None
) -> Catalog:
    """Catalog tables stored as ``<root>/<table>``: all, or those of ``tables``."""
    names = table_names() if tables is None else tables
    return Catalog.from_frames(
        **{name: spark.read.format(file_format).load(f"{root}/{name}") for name in names}
    )
