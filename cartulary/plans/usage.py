"""Queries over a tenant's usage events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.plans.event_catalog import (
    ENVELOPE,
    column_name,
    entry_name,
    event_dictionary,
    event_properties_by_type,
    is_type,
    known_type,
    meaning,
)
from cartulary.operators.ordinals import with_ordinals

# Event types of the ready-made queries.
SAVED_SEARCH_CREATED = "Engagement saved_search created"
SEMANTIC_SEARCH = "Search semantic search attempted"
SEARCH = "Search search attempted"
SIGN_IN = "General sign_in attempted"


def sample_events(events: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` events."""
    return events.limit(n)


def _select(events: DataFrame, event_type: str, names: tuple[str, ...]) -> DataFrame:
    columns = [F.col(column_name(name)).alias(column_name(name)) for name in names]
    return events.where(is_type(event_type)).select(*columns)


def event_properties(
    events: DataFrame, event_type: str, envelope: bool = False
) -> DataFrame:
    """Events of one type with the properties the dictionary lists for it."""
    names = event_properties_by_type()[known_type(event_type)]
    if envelope:
        names = (*ENVELOPE, *names)
    if not names:
        raise ValueError(f"{event_type!r} has no properties of its own; ask for the envelope")
    return _select(events, event_type, names)


def event_type_properties(events: DataFrame) -> DataFrame:
    """For each event type that occurs: how often, and which columns are meaningful for it.

    ``EVENT_TYPE, EVENTS, PROPERTY, COLUMN_NAME``; one row per property. The events are
    counted per type before they meet the dictionary, whose size is fixed.
    """
    counted = events.groupBy("EVENT_TYPE").agg(F.count(F.lit(1)).alias("EVENTS"))
    dictionary = event_dictionary(events.sparkSession).select(
        F.col("event_type").alias("entry"),
        F.col("property").alias("PROPERTY"),
        F.col("column_name").alias("COLUMN_NAME"),
    )
    return (
        counted.withColumn("name", entry_name())
        .join(F.broadcast(dictionary), F.col("name") == F.col("entry"), "left")
        .select(F.col("EVENT_TYPE").alias("EVENT_TYPE"), "EVENTS", "PROPERTY", "COLUMN_NAME")
    )


def event_values(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each value that an event has in a property of its type, for all types at once.

    The columns ``keep`` of the event, ``EVENT_TYPE`` as the dictionary names it, ``PROPERTY``,
    ``COLUMN_NAME`` and ``VALUE`` as text. The columns are turned into rows and only the filled ones
    that the dictionary lists for the type stay; its size is fixed.
    """
    present = {name.upper() for name in events.columns}
    listed = event_dictionary(events.sparkSession).where("property IS NOT NULL")
    columns = sorted(
        {column_name(n) for names in event_properties_by_type().values() for n in names} & present
    )
    held = [F.col(x).alias(f"__{x}") for x in keep]
    typed = events.select(
        *held, entry_name().alias("entry"), *(F.col(c).cast("string").alias(c) for c in columns)
    )
    ids = [*(f"__{x}" for x in keep), "entry"]
    filled = typed.unpivot(ids, columns, "column_name", "VALUE").where("VALUE IS NOT NULL")
    named = listed.select(F.col("event_type").alias("entry"), "column_name", F.col("property").alias("PROPERTY"))
    return filled.join(F.broadcast(named), ["entry", "column_name"]).select(
        *(F.col(f"__{x}").alias(x) for x in keep),
        F.col("entry").alias("EVENT_TYPE"),
        "PROPERTY",
        F.col("column_name").alias("COLUMN_NAME"),
        "VALUE",
    )


#: Values shown of each property, at most.
SAMPLES = 3


def event_profile(events: DataFrame) -> DataFrame:
    """The event dictionary with what the events hold: one row per type and property.

    ``EVENT_TYPE, DESCRIPTION, PROPERTY, COLUMN_NAME, EVENTS, FILLED, SAMPLE_VALUES``: how often the
    type occurs, in how many of its events the property has a value, and up to three values, those
    of the least digests, so every run shows the same. Types that do not occur have zeros; a type
    without properties has one row. The counts combine before the shuffle.
    """
    spark = events.sparkSession
    dictionary = event_dictionary(spark)
    samples = [F.expr(f"min_by(VALUE, md5('{k}' || VALUE))") for k in range(SAMPLES)]
    found = (
        event_values(events)
        .groupBy(F.col("EVENT_TYPE").alias("entry"), F.col("COLUMN_NAME").alias("column_name"))
        .agg(F.count(F.lit(1)).alias("FILLED"), F.array_distinct(F.array(*samples)).alias("SAMPLE_VALUES"))
    )
    counts = events.groupBy(entry_name().alias("entry")).agg(F.count(F.lit(1)).alias("EVENTS"))
    told = spark.createDataFrame(
        [(name, meaning(name)) for name in event_properties_by_type()], "event_type string, description string"
    )
    zero = F.lit(0).cast("long")
    return (
        dictionary.join(F.broadcast(told), "event_type")
        .withColumnRenamed("event_type", "entry")
        .join(counts, "entry", "left")
        .join(found, ["entry", "column_name"], "left")
        .select(
            F.col("entry").alias("EVENT_TYPE"),
            F.col("description").alias("DESCRIPTION"),
            F.col("property").alias("PROPERTY"),
            F.col("column_name").alias("COLUMN_NAME"),
            F.coalesce("EVENTS", zero).alias("EVENTS"),
            F.coalesce("FILLED", zero).alias("FILLED"),
            F.coalesce("SAMPLE_VALUES", F.array().cast("array<string>")).alias("SAMPLE_VALUES"),
        )
    )


def saved_searches(events: DataFrame) -> DataFrame:
    return _select(events, SAVED_SEARCH_CREATED, ("name", "keyword", "context", "facetsJSON"))


def semantic_searches(events: DataFrame) -> DataFrame:
    return _select(events, SEMANTIC_SEARCH, ("qaResponse", "searchResults"))


def popularity(
    events: DataFrame, event_type: str, column: str, top: int | None = None
) -> DataFrame:
    """Values of a column among the events of one type, most frequent first.

    A missing value is counted like any other. Equal counts are ordered by value, which also
    lets the sort split the many values that occur once.
    """
    name = column_name(column)
    ranked = (
        events.where(is_type(event_type))
        .groupBy(F.col(name).alias(name))
        .agg(F.count(F.lit(1)).alias("COUNT"))
        .orderBy(F.col("COUNT").desc(), F.col(name))
    )
    return ranked if top is None else ranked.limit(top)


def ranking(events: DataFrame, event_type: str, column: str) -> DataFrame:
    """All values of ``popularity`` with their place, ``RANK`` from 1; equal counts by value."""
    counted = popularity(events, event_type, column)
    order = [F.col("COUNT").desc(), F.col(column_name(column))]
    return with_ordinals(counted, order, "RANK")


def popular_queries(events: DataFrame, top: int | None = None) -> DataFrame:
    return popularity(events, SEARCH, "query", top)


def popular_filters(events: DataFrame, top: int | None = None) -> DataFrame:
    return popularity(events, SEARCH, "selectedFacets", top)


def sign_in_providers(events: DataFrame, top: int | None = None) -> DataFrame:
    return popularity(events, SIGN_IN, "identity_provider", top)


def top_sign_in_users(events: DataFrame, top: int | None = None) -> DataFrame:
    return popularity(events, SIGN_IN, "email", top)


def top_semantic_search_users(events: DataFrame, top: int | None = None) -> DataFrame:
    return popularity(events, SEMANTIC_SEARCH, "email", top)
