"""Enrichment reports of dashboards, datasets, virtual views and knowledge cards.

All four have one shape: own fields read from JSON documents, emails of the followers,
contacts with their designation, and the names of the governed tags.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.jsonx import VALUE, Field, quote, read_fields, read_for_filter
from cartulary.operators.grain import ASSET_TAG, apply_grain
from cartulary.operators.refs import CONTACTS as _CONTACTS
from cartulary.operators.refs import FOLLOWED_BY as _FOLLOWED_BY
from cartulary.operators.refs import ID, LISTS, entity_references
from cartulary.operators.refs import TAG_IDS as _TAG_IDS
from cartulary.semantics import DEFAULT_TUNING, VARIANT, Semantics, Tuning
from cartulary.sources.catalog import OPTIONAL_DOCUMENTS, Catalog

_AUDIT = ("_created_at", "last_modified_at", "last_ingested_at")
_REFERENCES = ("asset_followers", "asset_contacts", "asset_governed_tags")


@dataclass(frozen=True)
class Report:
    """``plain`` columns pass through, ``optional`` ones only where the table has them."""

    table: str
    plain: tuple[str, ...]
    fields: tuple[Field, ...]
    optional: tuple[str, ...] = ()


DATASETS = Report(
    table="datasets",
    plain=("id", "entity_type", *_AUDIT),
    fields=(
        Field("logical_id_name", "logical_id", "name"),
        Field("logical_id_platform", "logical_id", "platform"),
        Field("schema_description", "schema", "description"),
        Field("schema_entityId", "schema", "entityId"),
        Field("schema_fields", "schema", "fields", VALUE),
        Field("schema_sqlSchema_materialization", "schema", "sqlSchema.materialization"),
        Field("structure_database", "structure", "database"),
        Field("structure_schema", "structure", "schema"),
        Field("structure_table", "structure", "table"),
        Field("statistics_dataSizeBytes", "statistics", "dataSizeBytes"),
        Field("statistics_lastUpdated", "statistics", "lastUpdated"),
        Field("statistics_recordCount", "statistics", "recordCount"),
        Field("source_info_mainUrl", "source_info", "mainUrl"),
        Field("upstream_sourceDatasets", "entity_upstream", "sourceDatasets", VALUE),
        _FOLLOWED_BY, _CONTACTS, _TAG_IDS,
        Field("custom_metadata_metadata", "custom_metadata", "metadata", VALUE),
    ),
)

DASHBOARDS = Report(
    table="dashboards",
    plain=(
        "id", "entity_type", *_AUDIT, "source_info", "logical_id", "entity_upstream",
        "dashboard_info", *_REFERENCES,
    ),
    optional=("structure",),
    fields=(
        Field("dashboard_info_description", "dashboard_info", "description", VALUE),
        Field("dashboard_powerBI", "dashboard_info", "powerBi.powerBiDashboardType", VALUE),
        _FOLLOWED_BY, _CONTACTS, _TAG_IDS,
        Field("structure_name", "structure", "name", VALUE),
        Field("structure_directories", "structure", "directories", VALUE),
    ),
)

VIRTUAL_VIEWS = Report(
    table="virtual_views",
    plain=("id", "entity_type", *_AUDIT, *_REFERENCES),
    optional=("logical_id", "structure"),
    fields=(
        Field("name", "logical_id", "name"),
        _FOLLOWED_BY, _CONTACTS, _TAG_IDS,
        Field("structure_name", "structure", "name", VALUE),
        Field("structure_directories", "structure", "directories", VALUE),
    ),
)

KNOWLEDGE_CARDS = Report(
    table="knowledge_cards",
    plain=("id", "_created_at", "last_modified_at", *_REFERENCES),
    fields=(
        Field("created_by", "knowledge_card_info", "created.actor", VALUE),
        _CONTACTS, _TAG_IDS,
    ),
)


def own_columns(
    source: DataFrame,
    report: Report,
    extra: Sequence[str] = (),
    semantics: Semantics = VARIANT,
    for_filter: bool = False,
) -> DataFrame:
    """The report's own columns, read before any join so that no document is shuffled twice.

    The lists of references are left to ``attach_references``, which reads their documents.
    ``for_filter`` is for plain text whose fields are filtered on.
    """
    present = {name.lower() for name in source.columns}
    keep = [*report.plain, *(name for name in report.optional if name in present), *extra]
    absent = {field.doc for field in report.fields} - present
    if missing := absent - set(OPTIONAL_DOCUMENTS.get(report.table, ())):
        raise ValueError(f"{report.table} has no column {', '.join(sorted(missing))}")
    fields = [field for field in report.fields if field.doc in present and field not in LISTS]
    if for_filter:
        return read_for_filter(source, keep, fields)
    return read_fields(source, keep, fields, semantics)


def attach_references(
    base: DataFrame,
    source: DataFrame,
    catalog: Catalog,
    report: Report,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
    actor: Field | None = None,
) -> DataFrame:
    """Left-join the gathered references of ``source`` onto ``base``, and order the columns.

    The references are gathered by ``keys`` in one shuffle, as is ``base``.
    """
    resources, users = catalog.require("user_defined_resource", "users")
    gathered = entity_references(source, resources, users, keys, semantics, actor, tuning)
    joined = base.join(gathered, list(keys), "left")
    read = [field.column for field in report.fields if field in LISTS or field.column in base.columns]
    first = [name for name in base.columns if name not in read]
    creator = ["creator_email"] if actor else []
    found = ["tag_names", "n_tags", "asset_followers_emails", "asset_contacts_info"]
    return joined.select(*map(quote, [*first, *read, *creator, *found]))


def _entity_report(
    catalog: Catalog,
    report: Report,
    grain: str,
    semantics: Semantics,
    tuning: Tuning,
    actor: Field | None = None,
) -> DataFrame:
    (source,) = catalog.require(report.table)
    base = own_columns(source, report, semantics=semantics)
    attached = attach_references(
        base, source, catalog, report, semantics=semantics, tuning=tuning, actor=actor
    )
    return apply_grain(attached, grain, semantics)


def dataset_report(
    catalog: Catalog,
    grain: str = ASSET_TAG,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    return _entity_report(catalog, DATASETS, grain, semantics, tuning)


# Statistics that are whole numbers, and their typed columns.
_NUMBERS = {
    "statistics_dataSizeBytes": "data_size_bytes",
    "statistics_recordCount": "record_count",
}


def typed_statistics(report: DataFrame) -> DataFrame:
    """A dataset report with its statistics as whole numbers beside the texts.

    A text that is no whole number gives NULL.
    """
    typed = {new: F.expr(f"try_cast({quote(old)} AS BIGINT)") for old, new in _NUMBERS.items()}
    return report.withColumns(typed)


def dashboard_report(
    catalog: Catalog,
    grain: str = ASSET_TAG,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    return _entity_report(catalog, DASHBOARDS, grain, semantics, tuning)


def virtual_view_report(
    catalog: Catalog,
    grain: str = ASSET_TAG,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    return _entity_report(catalog, VIRTUAL_VIEWS, grain, semantics, tuning)


def knowledge_card_report(
    catalog: Catalog,
    grain: str = ASSET_TAG,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """As the other reports, with the email of the card's creator.

    The creator is one of the card's references: one user may have written a large share of the
    cards, and when the users are too many to broadcast, ids are shuffled by creator, not the cards.
    """
    actor = Field("actor", "knowledge_card_info", "created.actor")
    return _entity_report(catalog, KNOWLEDGE_CARDS, grain, semantics, tuning, actor)
