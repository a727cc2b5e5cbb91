"""Curated dataset report: production datasets with their merged descriptions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.arrays import null_if_empty
from cartulary.functions.jsonx import Field, may_mention, quote, read_fields, read_for_filter
from cartulary.operators.grain import ASSET, ASSET_TAG, apply_grain
from cartulary.operators.ordinals import with_ordinals
from cartulary.operators.refs import user_lookup
from cartulary.operators.skew import (
    hot_keys,
    key_counts,
    lookup_join,
    replicate_hot,
    spread_hot,
)
from cartulary.plans.entities import DATASETS, Report, attach_references, own_columns
from cartulary.semantics import DEFAULT_TUNING, VARIANT, Semantics, Tuning
from cartulary.sources.catalog import Catalog

REPEATED = "repeated"
ONCE = "once"

# Fixed value: the card type that describes an asset.
DESCRIPTION_CARD = "ASSET_DESCRIPTION"


def description_cards(cards: DataFrame) -> DataFrame:
    """``card_id, id, card_description, actor`` of the cards that describe an asset ``id``."""
    parsed = read_for_filter(
        cards.where(may_mention(cards, "knowledge_card_info", DESCRIPTION_CARD)).withColumnRenamed(
            "id", "card_id"
        ),
        ["card_id"],
        [
            Field("id", "knowledge_card_info", "anchorEntityId"),
            Field("card_type", "knowledge_card_info", "detail.type"),
            Field("card_description", "knowledge_card_info", "detail.assetDescription.description"),
            Field("actor", "knowledge_card_info", "created.actor"),
        ],
    )
    return parsed.where(f"card_type = '{DESCRIPTION_CARD}' AND id IS NOT NULL").drop("card_type")


def _entry(description: str, source: str) -> str:
    """A one-element list of a description, or an empty list."""
    entry = f"named_struct('description', {description}, 'source', {source})"
    return f"CASE WHEN {description} IS NOT NULL THEN array({entry}) ELSE array() END"


@dataclass(frozen=True)
class _Cards:
    """Description cards, their number per asset, and the assets with very many."""

    rows: DataFrame
    counts: DataFrame
    hot: DataFrame


def _cards(cards: DataFrame, tuning: Tuning) -> _Cards:
    rows = description_cards(cards)
    counts = key_counts(rows, "id", "n_cards")
    return _Cards(rows, counts, hot_keys(counts, "id", "n_cards", tuning=tuning))


def _attach_cards(
    base: DataFrame, cards: _Cards, users: DataFrame, tuning: Tuning
) -> DataFrame:
    """Fan ``base(id, salt, ...)`` out over its description cards.

    Adds ``n_cards`` (NULL without cards), ``card_description`` and ``card_author``. A piece of
    a hot dataset that no card fell into is dropped; a dataset without cards stays as one row.
    """
    authors = user_lookup(users, email="card_author")
    written = lookup_join(cards.rows, authors, "actor", "user_key", "left", tuning).drop("actor")
    pieces = spread_hot(written, "id", cards.hot, ["card_id"])
    counted = replicate_hot(cards.counts, "id", cards.hot)
    return (
        base.join(counted, ["id", "salt"], "left")
        .join(pieces, ["id", "salt"], "left")
        .where("card_id IS NOT NULL OR n_cards IS NULL")
    )


def _descriptions(own: str) -> str:
    """The source's description, if not empty, then the card's; NULL without either."""
    source = _entry(f"nullif({own}, '')", "logical_id_platform")
    user = _entry("card_description", "card_author")
    return null_if_empty(f"concat({source}, {user})")


def merged_descriptions(catalog: Catalog, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """``id, descriptions``, one row per dataset and description card."""
    datasets, cards, users = catalog.require("datasets", "knowledge_cards", "users")
    described = _cards(cards, tuning)
    source = replicate_hot(datasets, "id", described.hot)
    base = read_fields(
        source,
        ["id", "salt"],
        [
            Field("own_description", "schema", "description"),
            Field("logical_id_platform", "logical_id", "platform"),
        ],
    )
    fanned = _attach_cards(base, described, users, tuning)
    return fanned.selectExpr("id", f"{_descriptions('own_description')} AS descriptions")


def curated_dataset_report(
    catalog: Catalog,
    grain: str = ASSET_TAG,
    ordered: bool = True,
    tag_name_copies: str = ONCE,
    tuning: Tuning = DEFAULT_TUNING,
    names_joined_by: str | None = None,
) -> DataFrame:
    """Production datasets with fields, one row per dataset, description card and tag.

    With ``tag_name_copies='once'`` names appear once and ``n_cards`` says how often they would
    be repeated; the result is linear in the cards. With ``'repeated'`` each tag name appears once
    per description card of the dataset, as a window over the joined rows gives it: that array
    grows with the number of cards on each of their rows.

    With ``names_joined_by`` the names of a row, copies included, are one text in the order of the names,
    joined by that text. It is made by repeating each name as a whole, so that it costs the bytes it
    holds and nothing for each copy.
    """
    if tag_name_copies not in (REPEATED, ONCE):
        raise ValueError(f"tag_name_copies must be {REPEATED!r} or {ONCE!r}")
    datasets, cards, users = catalog.require("datasets", "knowledge_cards", "users")
    production = datasets.where("is_non_prod = FALSE")
    described = _cards(cards, tuning)
    source = replicate_hot(production, "id", described.hot)

    keys = ("id", "salt")
    report = _without_metadata()
    base = own_columns(source, report, extra=["is_non_prod", "salt"], for_filter=True).where(
        "schema_fields IS NOT NULL"
    )
    attached = attach_references(base, source, catalog, report, keys, VARIANT, tuning)
    fanned = _attach_cards(attached, described, users, tuning)

    dropped = ("salt", "card_description", "card_author", "schema_description")
    report = fanned.selectExpr(
        *(quote(name) for name in fanned.columns if name not in dropped),
        f"to_json({_descriptions('schema_description')}) AS schema_description",
    )
    if ordered:
        report = _sorted_by_description(report)
    # Rows and names are repeated after the sort, which moves the short form and whose order
    # both steps keep. The copies of a name stand together, in the order of the names, so that what
    # sorts such a long array only reads it.
    copies = F.expr("CAST(coalesce(n_cards, 1) AS INT)") if tag_name_copies == REPEATED else F.lit(1)
    as_text = names_joined_by is not None
    ordered_names = F.sort_array("tag_names")
    if as_text:
        by = F.lit(names_joined_by)
        runs = F.transform(ordered_names, lambda x: F.concat(F.repeat(F.concat(x, by), copies - 1), x))
        report = report.withColumn("tag_names", F.array_join(runs, names_joined_by))
    elif tag_name_copies == REPEATED:
        runs = F.transform(ordered_names, lambda x: F.array_repeat(x, copies))
        report = report.withColumn("tag_names", F.flatten(runs))
    if tag_name_copies == REPEATED:
        report = report.drop("n_cards")
    return apply_grain(report.drop("card_id"), grain, VARIANT, as_text)


def curated_dataset_places(
    catalog: Catalog, tuning: Tuning = DEFAULT_TUNING, name: str = "place"
) -> DataFrame:
    """The curated report, one row per dataset and card, each with its place in the report's order.

    Descriptions ascend, missing ones are last, and equal ones go by id. Tag names appear once.
    """
    report = curated_dataset_report(catalog, ASSET, ordered=False, tuning=tuning)
    return with_ordinals(report, [F.col("schema_description").asc_nulls_last(), "id"], name)


def _without_metadata() -> Report:
    fields = tuple(f for f in DATASETS.fields if f.doc != "custom_metadata")
    return replace(DATASETS, fields=fields)


def _sorted_by_description(report: DataFrame) -> DataFrame:
    """Descriptions ascending, missing ones last.

    Equal descriptions are ordered further, so that the range partitions of the sort can
    split them. Their number is fixed: AQE would merge them by the bytes of the short form, and each
    row becomes much longer in the task that reads it.
    """
    order = (F.col("schema_description").asc_nulls_last(), F.col("id").asc(), F.col("card_id").asc())
    ranges = int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return report.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
