"""User profile report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartulary.functions.arrays import null_if_empty
from cartulary.functions.jsonx import Field, read_fields, text_array, text_in
from cartulary.operators.refs import follower_emails
from cartulary.semantics import DEFAULT_TUNING, VARIANT, Semantics, Tuning
from cartulary.sources.catalog import Catalog


def keyword_array(users: DataFrame, semantics: Semantics = VARIANT) -> str:
    """Expression for the keywords of a user's recent searches; NULL without searches.

    The searches of a user sit in one document, so no grouping is needed.
    """
    searches = null_if_empty(text_array(users, "activity", "recentSearches"))
    keywords = f"transform({searches}, s -> {text_in('s', 'keyword')})"
    if semantics.keep_null_elements:
        return keywords
    return f"filter({keywords}, k -> k IS NOT NULL)"


def user_report(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """One row per user; the follower columns appear where the table has them."""
    (users,) = catalog.require("users")
    keywords = f"{keyword_array(users, semantics)} AS recent_searches_keywords"
    with_keywords = users.selectExpr("*", keywords)
    followed = ["asset_followers"] if "asset_followers" in users.columns else []
    plain = [
        "id", "display_name", "_created_at", "last_modified_at", "properties",
        "recent_searches_keywords", "activity", *followed,
    ]
    report = read_fields(
        with_keywords,
        plain,
        [Field("email", "logical_id", "email"), Field("role", "properties", "role")],
        semantics,
    )
    if not followed:
        return report
    emails = follower_emails(users, users, semantics=semantics, tuning=tuning)
    return report.join(emails, "id", "left")
