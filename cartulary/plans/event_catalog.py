"""Which properties are meaningful for which type of usage event.

Every event also has the envelope columns. An event type with a bracketed part stands for all
types that start with the text before the bracket.
"""

from __future__ import annotations

import difflib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of every event.
ENVELOPE = ("eventType", "deployedDomain", "pageType", "page")

# Event types, each with its properties, as they occur in the event tables.
EVENT_PROPERTIES = """
General sign_in attempted: identity_provider
General sign_in_page viewed
General sign_in failed: reason
PageViewEvent [page name]: hash, query
Search search attempted: query, context, interaction, latency, facets, selectedFacets, selectedFilters
Search suggestion selected: input, context, interaction, latency, suggestion_selected
Search top_hashtag selected: hashtag
Support feedback_form accessed
Support support_center accessed: cta
Onboarding slack installed: person_id
Engagement linege_graph interacted: num_nodes_shown, asset_id, latency, asset_type
Engagement share_asset performed: asset_id, type
Engagement config_ownership interacted: owner, external
Engagement knowledge_card creation_attempted: cta, card_type, anchor_id, num_char_body, plannedDate
Engagement knowledge_card filtered_display: filters
Engagement knowledge_card edited: asset_id
Engagement knowledge_card unsuccessful_creation: did_change_defaults, anchor_id
Engagement knowledge_card archived: asset_id
Engagement asset_page from_slack: asset_id
Engagement asset followed: asset_id
Engagement asset unfollowed: asset_id
Engagement governed_tag assigned: asset_id, tag_id
Engagement governed_tag unassigned: asset_id, tag_id
Engagement asset_description added: asset_id
Engagement directory created: directory_id, name_at_creation
Engagement knowledge_card created: cta, card_type, asset_id, anchor_id, num_char_body, plannedDate
Engagement lineage panel_opened: asset_id
Engagement lineage impact_analysis_mode_shown: asset_id
Engagement lineage associated_user_list_accessed: access_type, asset_id
Engagement lineage node_details_viewed: asset_id
Engagement document copied: asset_id
Engagement document created: asset_id
Engagement document moved: asset_id, moved_to_dir_with_id
Engagement column_governed_tag assigned: column_names, asset_id, tags_added
Engagement column_governed_tag unassigned: column_names, asset_id, tags_removed
Engagement column_description added: column_name, asset_id
Engagement bulk_action governed_tags_updated: number_of_objects_impacted, tags_added, tags_removed
Engagement bulk_action asset_contacts_updated: number_of_objects_impacted, contacts_types_added, contacts_types_removed
Engagement who_viewed_this_asset opened: asset_id
Engagement directory documents_filtered: statuses, tags, directory_id
Engagement change_request sent: anchor_id, asset_id, type
Engagement change_request status_change_attempted: asset_id, status
Engagement change_request status_changed: asset_id, status
Engagement change_request acknowledged: anchor_id, asset_id, type
Engagement data_group created: data_group_id
Engagement data_group moved: data_group_id, moved_to_parent_id
Engagement directory moved: directory_id, moved_to_parent_id
Engagement additional_asset_likers shown: asset_id, performed_by_author
Engagement app_home opened
Engagement link_unfurling performed: asset_id
Engagement share_asset attempted: asset_id
Engagement version_history history_list_shown: asset_id
Engagement version_history version_requested: asset_id, version_id
Engagement app installed
Engagement app uninstalled
Engagement asset pinned: asset_id
Engagement asset unpinned: asset_id
Engagement request_instance_form shown: viewer_email
Engagement request_instance_form submitted: viewer_email
Engagement asset_contact updated: contact_types_added
Search semantic search attempted: query, qaResponse, searchResults
Engagement coverage_analytics shown
Engagement saved_search created: name, keyword, context, facetsJSON
Engagement saved_search applied: name, keyword, context, facetsJSON
Onboarding persona created: persona
Onboarding persona updated: persona
Engagement universal_search liked: question, answer
Engagement universal_search disliked: question, answer, feedback
Engagement extension_popup opened: asset_id
Engagement extension_popup closed: asset_id
General extension installed
Engagement list_of_viewers_from_source_system shown: asset_id
Engagement list_of_subscribers_from_source_system shown: asset_id
Search search_result primary_action_performed: query, context, position, asset_id, facets
Search search_result impression: query, context, asset_id, position, facets
Engagement search_result_action_menu opened: query
Engagement non_production_assets_switch changed: state
Engagement comment added: comment_id, asset_id, is_reply, parent_comment_id
Search search_result non_primary_action_performed: query, context, position, asset_id, facets, label
Engagement support_widget opened: widget
Engagement data_quality_widget opened: dataQualityStatus
Engagement data_quality_widget closed: dataQualityStatus
Engagement data_quality_source_asset viewed: dataQualityStatus
Engagement data_quality_show_details clicked: dataQualityStatus
Engagement data_quality_column_status clicked: dataQualityStatus
Engagement common_attribute added: name, tags_count, contacts_count
Engagement common_attribute deleted: name, tags_count, contacts_count
Engagement common_attribute edited: name, tags_count, contacts_count
Engagement common_attribute_creation cancelled
Engagement activity_feed_item interaction: feed_position, asset_id, asset_name
Engagement activity_feed impression
Engagement activity_feed_item impression: feed_position, asset_id, asset_name
Engagement activity_feed content_added: size
"""


@cache
def event_properties_by_type() -> dict[str, tuple[str, ...]]:
    table = {}
    for line in EVENT_PROPERTIES.strip().splitlines():
        event_type, _, names = line.partition(":")
        table[event_type] = tuple(name.strip() for name in names.split(",") if name.strip())
    return table


def template_prefix(event_type: str) -> str | None:
    """Text all types of a template start with, None if the type is no template."""
    prefix, bracket, _ = event_type.partition("[")
    return prefix if bracket else None


def column_name(name: str) -> str:
    """Column that holds a property: upper case, with no word split."""
    return name.upper()


def meaning(event_type: str) -> str:
    """What an event of the type tells, from the parts of its name: area, subject and what happened."""
    prefix = template_prefix(event_type)
    if prefix is not None:
        return f"A user opened a page; the type ends with its name ({prefix.strip()})."
    area, *subject = event_type.replace("_", " ").split(" ")
    *thing, action = subject or [area]
    was = "" if action in ("failed", "clicked through") else "was "
    return f"{area}: {' '.join(thing)} {was}{action}." if thing else f"{area}: {action}."


def known_type(event_type: str) -> str:
    """The dictionary's entry for an event type; an unknown type is an error."""
    table = event_properties_by_type()
    if event_type in table:
        return event_type
    for entry in table:
        prefix = template_prefix(entry)
        if prefix is not None and event_type.startswith(prefix):
            return entry
    close = difflib.get_close_matches(event_type, table, n=3)
    hint = f"; did you mean {', '.join(map(repr, close))}?" if close else ""
    raise ValueError(f"unknown event type {event_type!r}{hint}")


def is_type(event_type: str, column: str = "EVENT_TYPE") -> Column:
    """Rows of an event type; the name of a template selects all its types."""
    prefix = template_prefix(event_type)
    return F.col(column).startswith(prefix) if prefix else F.col(column) == event_type


def entry_name(column: str = "EVENT_TYPE") -> Column:
    """Name under which the dictionary lists the event type of a row."""
    name = F.col(column)
    for entry in event_properties_by_type():
        prefix = template_prefix(entry)
        if prefix is not None:
            name = F.when(F.col(column).startswith(prefix), F.lit(entry)).otherwise(name)
    return name


def event_dictionary(spark: SparkSession) -> DataFrame:
    """``event_type, position, property, column_name``; NULL property for a type without any."""
    rows = []
    for event_type, names in event_properties_by_type().items():
        for position, name in enumerate(names, start=1):
            rows.append((event_type, position, name, column_name(name)))
        if not names:
            rows.append((event_type, 0, None, None))
    return spark.createDataFrame(
        rows, "event_type string, position int, property string, column_name string"
    )
