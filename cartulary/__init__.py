"""Catalog metadata enrichment and product usage analytics as Spark DataFrame operators."""

from cartulary.operators.ordinals import with_ordinals
from cartulary.operators.uniqueness import LookupCheck
from cartulary.plans.curated import (
    curated_dataset_places,
    curated_dataset_report,
    merged_descriptions,
)
from cartulary.plans.domains import (
    domain_asset_details,
    domain_asset_names,
    domain_classification,
    domain_contacts,
    domain_creator,
    domain_descendants,
    domain_description,
    domain_followers,
    domain_queries_long,
    domain_query_sizes,
    domain_report,
    domain_tags,
    domain_top_queries,
)
from cartulary.plans.entities import (
    dashboard_report,
    dataset_report,
    knowledge_card_report,
    typed_statistics,
    virtual_view_report,
)
from cartulary.plans.usage import (
    event_profile,
    event_properties,
    event_type_properties,
    event_values,
    popular_filters,
    popular_queries,
    popularity,
    ranking,
    sample_events,
    saved_searches,
    semantic_searches,
    sign_in_providers,
    top_semantic_search_users,
    top_sign_in_users,
)
from cartulary.plans.users import user_report
from cartulary.semantics import PRESTO, VARIANT, Semantics, Tuning
from cartulary.sources.catalog import (
    Catalog,
    duplicate_ids,
    load_catalog,
    load_catalog_files,
    load_table,
    normalize_catalog,
)
from cartulary.sources.events import load_events
from cartulary.sources.layout import save_catalog, save_events

__all__ = [
    "Catalog",
    "LookupCheck",
    "PRESTO",
    "Semantics",
    "Tuning",
    "VARIANT",
    "curated_dataset_places",
    "curated_dataset_report",
    "dashboard_report",
    "dataset_report",
    "domain_asset_details",
    "domain_asset_names",
    "domain_classification",
    "domain_contacts",
    "domain_creator",
    "domain_descendants",
    "domain_description",
    "domain_followers",
    "domain_queries_long",
    "domain_query_sizes",
    "domain_report",
    "domain_tags",
    "domain_top_queries",
    "duplicate_ids",
    "event_profile",
    "event_properties",
    "event_type_properties",
    "event_values",
    "knowledge_card_report",
    "load_catalog",
    "load_catalog_files",
    "load_events",
    "load_table",
    "merged_descriptions",
    "normalize_catalog",
    "popular_filters",
    "popular_queries",
    "popularity",
    "ranking",
    "sample_events",
    "save_catalog",
    "save_events",
    "saved_searches",
    "semantic_searches",
    "sign_in_providers",
    "top_semantic_search_users",
    "top_sign_in_users",
    "typed_statistics",
    "user_report",
    "virtual_view_report",
    "with_ordinals",
]
