"""Domains, sub-domains and data products: what they are, hold, and who is behind them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.arrays import collect, make_object, null_if_empty
from cartulary.functions.jsonx import Field, may_mention, quote, read_fields, read_for_filter, text_at
from cartulary.operators.closure import descendants
from cartulary.operators.refs import (
    IS_CONTACT,
    IS_FOLLOWER,
    IS_OWN,
    IS_TAG,
    contacts_long,
    follower_ids,
    gather,
    reference_edges,
    resolve_contacts,
    resolve_followers,
    resolve_tags,
    resolved_edges,
    tag_ids,
    user_lookup,
)
from cartulary.operators.skew import (
    fan_out_join,
    hot_keys,
    key_counts,
    lookup_join,
    replicate_hot,
    spread_hot,
)
from cartulary.semantics import DEFAULT_TUNING, VARIANT, Semantics, Tuning
from cartulary.sources.catalog import Catalog

# Namespace and card types.
DATA_GROUP = "DATA_GROUP"
DATA_UNIT = "DATA_UNIT"
QUERY_CARD = "QUERY_DESCRIPTION"

_INFO_FIELDS = (
    Field("ns_name", "namespace_info", "name"),
    Field("ns_type", "namespace_info", "detail.type"),
    Field("ns_parent", "namespace_info", "parentId"),
    Field("ns_created", "namespace_info", "created.time"),
    Field("ns_description", "namespace_info", "description.text"),
)

_CLASSES = tuple(
    f"CASE WHEN {condition} THEN ns_name ELSE '' END AS {name}"
    for name, condition in (
        ("domain_name", f"ns_type = '{DATA_GROUP}' AND ns_parent IS NULL"),
        ("subdomain_name", f"ns_type = '{DATA_GROUP}' AND ns_parent IS NOT NULL"),
        ("data_product_name", f"ns_type = '{DATA_UNIT}'"),
    )
)


def domain_classification(namespaces: DataFrame) -> DataFrame:
    """A group without parent is a domain, with parent a sub-domain; a unit is a data product."""
    parsed = read_fields(namespaces, ["id"], _INFO_FIELDS[:3])
    return parsed.selectExpr("id AS domain_id", *_CLASSES)


def _listed_assets(domain_assets: DataFrame) -> DataFrame:
    """Distinct ``id, parent, asset``; repeats within a row go before the shuffle."""
    both = "array_distinct(concat(live_query_assets, selected_assets))"
    return domain_assets.selectExpr(
        "_id AS id", "parent", f"explode(CAST({both} AS ARRAY<STRING>)) AS asset"
    ).distinct()


def domain_asset_details(domain_assets: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Distinct ``id, name, parent, asset`` of the assets a namespace lists.

    Walking the hierarchy would only repeat these rows once per ancestor before the distinct,
    so the list is read flat. A namespace with one missing list has no rows.
    """
    names = namespaces.selectExpr("id AS ns_id", f"{text_at(namespaces, 'namespace_info', 'name')} AS name")
    return (
        _listed_assets(domain_assets)
        .join(names, F.expr("id = ns_id"), "left")
        .select("id", "name", "parent", "asset")
    )


def _asset_ids(domain_assets: DataFrame) -> DataFrame:
    """``id, asset`` at the grain of the details, so an asset under two parents comes twice."""
    return _listed_assets(domain_assets).select("id", "asset")


def asset_names(assets: DataFrame, catalog: Catalog) -> DataFrame:
    """``asset_id, name, workspace`` of ids that may be dashboards, datasets or views.

    The listed ids and the three tables are one stream that is reduced by id in one shuffle. The
    name is that of the first table, in this order, that has one; the workspace a dashboard's
    platform. An asset listed by very many namespaces is looked up once.
    """
    dashboards, datasets, views = catalog.require("dashboards", "datasets", "virtual_views")
    none = "CAST(NULL AS STRING)"
    named = (
        (dashboards, text_at(dashboards, "dashboard_info", "title"),
         f"nullif({text_at(dashboards, 'logical_id', 'platform')}, '')"),
        (datasets, text_at(datasets, "logical_id", "name"), none),
        (views, text_at(views, "structure", "name"), none),
    )
    stream = assets.where("asset IS NOT NULL").selectExpr(
        "asset AS asset_id", "true AS listed", "0 AS place", f"{none} AS name", f"{none} AS workspace"
    )
    for place, (table, name, workspace) in enumerate(named, start=1):
        stream = stream.unionAll(
            table.selectExpr(
                "CAST(id AS STRING)", "false", str(place), f"{name} AS name", f"{workspace} AS workspace"
            )
        )
    reduced = stream.groupBy("asset_id").agg(
        F.expr("bool_or(listed) AS listed"),
        F.expr("min_by(name, place) FILTER (WHERE name IS NOT NULL) AS name"),
        F.expr("max(workspace) AS workspace"),
    )
    return reduced.where("listed").drop("listed")


def domain_asset_names(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """``id, assets``: per namespace an object for each listed asset.

    The array is as long as the lists in the namespace's own rows.
    """
    (domain_assets,) = catalog.require("domain_assets")
    listed = _asset_ids(domain_assets)
    resolved = lookup_join(
        listed, asset_names(listed, catalog), "asset", "asset_id", "left", tuning
    )
    entry = make_object({"asset_id": "asset", "name": "name", "workspace": "workspace"}, semantics)
    return _gather(resolved, entry, "assets", semantics)


def _gather(rows: DataFrame, entry: str, name: str, semantics: Semantics) -> DataFrame:
    return rows.groupBy("id").agg(F.expr(f"{collect(entry, semantics)} AS {name}"))


def _person(semantics: Semantics) -> str:
    return make_object({"name": "display_name", "email": "email"}, semantics)


def domain_tags(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    namespaces, resources = catalog.require("namespaces", "user_defined_resource")
    known = resolve_tags(tag_ids(namespaces), resources, description=True, tuning=tuning)
    tag = make_object({n: n for n in ("tag_id", "tag_name", "tag_description")}, semantics)
    return _gather(known, tag, "tags", semantics)


def domain_followers(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    namespaces, users = catalog.require("namespaces", "users")
    known = resolve_followers(follower_ids(namespaces), users, name=True, tuning=tuning)
    return _gather(known, _person(semantics), "followers", semantics)


def domain_contacts(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """Contacts by name and email; their designation must be known but is not shown."""
    namespaces, resources, users = catalog.require("namespaces", "user_defined_resource", "users")
    known = resolve_contacts(contacts_long(namespaces), resources, users, name=True, tuning=tuning)
    return _gather(known, _person(semantics), "contacts", semantics)


def domain_creator(
    catalog: Catalog, semantics: Semantics = VARIANT, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """``id, created_by``: the creator as a list; an unknown creator is an empty object."""
    namespaces, users = catalog.require("namespaces", "users")
    created = namespaces.selectExpr("id", f"{text_at(namespaces, 'namespace_info', 'created.actor')} AS actor")
    people = user_lookup(users, "display_name")
    known = lookup_join(created, people, "actor", "user_key", "left", tuning)
    return _gather(known, _person(semantics), "created_by", semantics)


def namespace_references(
    namespaces: DataFrame,
    catalog: Catalog,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """``id, tags, followers, contacts, created_by``: all references of a namespace in one shuffle.

    The columns are those of the four functions before.
    """
    resources, users = catalog.require("user_defined_resource", "users")
    actor = Field("actor", "namespace_info", "created.actor")
    resolved = resolved_edges(
        reference_edges(namespaces, semantics=semantics, actor=actor),
        resources,
        users,
        ("tag_name", "tag_description"),
        ("display_name",),
        tuning=tuning,
    )
    tag = make_object(
        {"tag_id": "resource_id", "tag_name": "tag_name", "tag_description": "tag_description"},
        semantics,
    )
    person = _person(semantics)
    return gather(
        resolved,
        {
            "tags": (IS_TAG, tag),
            "followers": (IS_FOLLOWER, person),
            "contacts": (IS_CONTACT, person),
            "created_by": (IS_OWN, person),
        },
        semantics=semantics,
    )


def _described_cards(cards: DataFrame) -> DataFrame:
    """Cards of any type that carry a description, by the ``id`` they are about."""
    parsed = read_for_filter(
        cards.where(may_mention(cards, "knowledge_card_info", "assetDescription")).withColumnRenamed(
            "id", "card_id"
        ),
        ["card_id"],
        [
            Field("id", "knowledge_card_info", "anchorEntityId"),
            Field("card_description", "knowledge_card_info", "detail.assetDescription.description"),
        ],
    )
    return parsed.where("card_description IS NOT NULL AND id IS NOT NULL")


def _fan_out_descriptions(
    base: DataFrame,
    cards: DataFrame,
    owners: DataFrame,
    tuning: Tuning,
    cells: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Left-join description cards onto ``base(id, ...)``, adding ``card_description``.

    Only cards about one of the ``owners(id)`` are looked at. A namespace with very many cards
    is split into pieces of its cards, and a piece that no card fell into is dropped. ``cells`` adds
    wide columns to the rows, by ``id, salt``, from the hot namespaces; they come last, so that they
    are copied for each card where the rows are made, and are not moved with them.
    """
    namespace_cards = lookup_join(
        _described_cards(cards), owners.selectExpr("id AS owner"), "id", "owner", tuning=tuning
    )
    hot = hot_keys(key_counts(namespace_cards, "id"), "id", tuning=tuning)
    is_split = hot.selectExpr("hot_key", "true AS split")
    pieces = spread_hot(namespace_cards, "id", hot, ["card_id"])
    fanned = (
        replicate_hot(base, "id", hot)
        .join(F.broadcast(is_split), F.expr("id = hot_key"), "left")
        .join(pieces, ["id", "salt"], "left")
        .where("card_id IS NOT NULL OR split IS NULL")
    )
    if cells is not None:
        fanned = cells(fanned, hot)
    return fanned.drop("salt", "split", "hot_key", "card_id")


def domain_description(catalog: Catalog, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """``id, description``: own text, else a card's; one row per namespace and card."""
    namespaces, cards = catalog.require("namespaces", "knowledge_cards")
    own = text_at(namespaces, "namespace_info", "description.text")
    base = namespaces.selectExpr("id", f"{own} AS ns_description")
    return _fan_out_descriptions(base, cards, namespaces, tuning).selectExpr(
        "id", "coalesce(ns_description, card_description) AS description"
    )


def curated_query_cards(cards: DataFrame) -> DataFrame:
    """``card_id, asset, title, explanation, query`` of live cards marked as curated."""
    live = cards.where("deleted_at IS NULL").where(may_mention(cards, "knowledge_card_info", QUERY_CARD))
    parsed = read_for_filter(
        live.withColumnRenamed("id", "card_id"),
        ["card_id"],
        [
            Field("asset", "knowledge_card_info", "anchorEntityId"),
            Field("card_type", "knowledge_card_info", "detail.type"),
            Field("curated", "knowledge_card_info", "detail.query.isMarkedAsCurated"),
            Field("title", "knowledge_card_info", "detail.query.title"),
            Field(
                "explanation",
                "knowledge_card_info",
                "detail.query.explanations[0].explanation",
            ),
            Field("query", "knowledge_card_info", "detail.query.query"),
        ],
    )
    return parsed.where(f"card_type = '{QUERY_CARD}' AND curated = 'true'").drop(
        "card_type", "curated"
    )


def _filled_query_cards(cards: DataFrame) -> DataFrame:
    return curated_query_cards(cards).where(
        "coalesce(title, explanation, query) IS NOT NULL AND asset IS NOT NULL"
    )


def domain_queries_long(catalog: Catalog, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """One row per namespace, listed asset and curated query of that asset.

    Adds ``card_id``. Queries with neither title, explanation nor text are left out.
    """
    domain_assets, cards = catalog.require("domain_assets", "knowledge_cards")
    listed = _asset_ids(domain_assets).where("asset IS NOT NULL")
    return fan_out_join(
        listed, _filled_query_cards(cards), "asset", ["id"], ["card_id"], tuning=tuning
    )


def domain_query_sizes(catalog: Catalog, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """``id, n_queries, n_bytes`` of what ``domain_top_queries`` would put into one cell.

    Bytes are those of the three texts. Counts combine before the shuffle.
    """
    texts = " + ".join(f"coalesce(octet_length({x}), 0)" for x in ("title", "explanation", "query"))
    return (
        domain_queries_long(catalog, tuning)
        .groupBy("id")
        .agg(F.expr("count(1) AS n_queries"), F.expr(f"sum(CAST({texts} AS BIGINT)) AS n_bytes"))
    )


#: Pieces that the rows of one long list are dealt into.
PIECES = 256


def _gather_in_pieces(
    rows: DataFrame, entry: str, by: str, name: str, semantics: Semantics, key: str = "id"
) -> DataFrame:
    """``key, name``: as ``_gather``, for lists without a bound.

    The rows of a key are dealt into pieces by a hash of ``by``; a task lists a piece, and
    what puts the pieces together, in their order, only joins at most ``PIECES`` lists. So a task
    never reads a long list row by row, and nothing has to be counted first.
    """
    piece = f"CAST(pmod(xxhash64({by}), {PIECES}) AS INT) AS __piece"
    listed = (
        rows.selectExpr("*", piece)
        .groupBy(key, "__piece")
        .agg(F.expr(f"{collect(entry, semantics)} AS __list"))
    )
    joined = listed.groupBy(key).agg(F.expr("array_sort(collect_list(struct(__piece, __list))) AS __all"))
    return joined.selectExpr(key, f"flatten(transform(__all, p -> p.__list)) AS {name}")


def _top_queries(
    listed: DataFrame, cards: DataFrame, keys: list[str], semantics: Semantics, tuning: Tuning
) -> DataFrame:
    """``keys, top_queries`` of ``listed(keys, asset)``.

    The queries of an asset are listed once, and its list goes to all that list the asset: a cell is a
    few lists put together, not very many rows.
    """
    entry = make_object({n: n for n in ("title", "explanation", "query")}, semantics)
    queries = _gather_in_pieces(
        _filled_query_cards(cards), entry, "card_id", "queries", semantics, "asset"
    )
    known = listed.where("asset IS NOT NULL AND id IS NOT NULL")
    found = fan_out_join(known, queries, "asset", keys, ["asset"], "size(queries)", tuning)
    none = found.select("queries").schema[0].dataType.simpleString()
    every = listed.selectExpr(*keys, f"CAST(NULL AS {none}) AS queries").distinct()
    gathered = found.select(*keys, "queries").unionByName(every).groupBy(*keys).agg(
        F.expr("flatten(collect_list(queries)) AS found_queries")
    )
    return gathered.selectExpr(*keys, f"{null_if_empty('found_queries')} AS top_queries")


#: Queries that a block of cells makes, in ``hot_pairs``.
BLOCK_PAIRS = 2


def _with_joined_queries(
    rows: DataFrame,
    listed: DataFrame,
    cards: DataFrame,
    keys: list[str],
    joined_by: str,
    semantics: Semantics,
    tuning: Tuning,
) -> DataFrame:
    """``rows(keys, ...)`` with ``top_queries``, one text, of ``listed(keys, asset)``; NULL without queries.

    A text is made in the task that gives its row and is never moved. Cells with the same longest list
    are dealt into blocks, and a block gets each list that its cells hold once, however many they are:
    what is moved are the lists. A block makes about ``BLOCK_PAIRS`` times ``hot_pairs`` queries; there
    are as many tasks, which a job of its own counts before. Cells of long lists come first in a task:
    a writer that sets its buffer by the first rows would else hold very many long ones.
    """
    entry = make_object({n: n for n in ("title", "explanation", "query")}, semantics)
    text = entry if semantics.keep_null_fields else f"to_json({entry})"
    queries = _gather_in_pieces(
        _filled_query_cards(cards), text, "card_id", "queries", semantics, "asset"
    )
    counts = queries.selectExpr("asset AS query_asset", "size(queries) AS n_queries")
    known = listed.where("asset IS NOT NULL AND id IS NOT NULL")
    held = lookup_join(known, counts, "asset", "query_asset", tuning=tuning).groupBy(*keys).agg(
        F.expr("max(struct(n_queries, asset)) AS most"),
        F.expr("sum(n_queries) AS n_made"),
        F.expr("collect_list(asset) AS held"),
    )
    loads = held.groupBy("most.asset").agg(F.expr("sum(n_made) AS made"))
    made = loads.agg(F.expr("coalesce(sum(made), 0) AS made")).first().made
    size = BLOCK_PAIRS * tuning.hot_pairs
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, math.ceil(made / size))

    loads = loads.selectExpr("asset AS load_asset", f"ceil(made / {size}) AS pieces")
    each = ", ".join(map(quote, keys))
    longest = held.selectExpr(*keys, "most.asset AS longest", "-most.n_queries AS block_order", "held")
    at = lookup_join(longest, loads, "longest", "load_asset", tuning=tuning).selectExpr(
        *keys,
        "block_order",
        "longest",
        f"CAST(pmod(xxhash64({each}), pieces) AS INT) AS block_salt",
        "explode(held) AS asset",
    )
    block = ["block_order", "longest", "block_salt"]
    placed = (
        at.groupBy(*block)
        .agg(F.expr("array_sort(collect_set(asset)) AS assets"))
        .selectExpr(*block, "posexplode(assets) AS (place, asset)")
    )
    places = at.join(placed, [*block, "asset"]).groupBy(*keys).agg(
        *(F.expr(f"max({n}) AS {n}") for n in block), F.expr("collect_list(place) AS places")
    )

    def with_text(held: Column) -> Column:
        return F.struct(held["queries"], F.array_join(held["queries"], joined_by).alias("text"))

    # Ordered once for each asset, so that ordering a text only merges its lists.
    ordered = queries.selectExpr("asset", "sort_array(queries) AS queries")
    lists = (
        placed.join(ordered, "asset")
        .repartition(tasks, *block)
        .groupBy(*block)
        .agg(F.expr("array_sort(collect_list(struct(place, queries))) AS lists"))
        .withColumn("lists", F.transform("lists", with_text))
    )
    alone = {
        "block_order": F.expr("coalesce(block_order, 0)"),
        "block_salt": F.expr(f"coalesce(block_salt, CAST(pmod(xxhash64({each}), {PIECES}) AS INT))"),
    }
    dealt = (
        rows.join(places, keys, "left")
        .withColumns(alone)
        .repartition(tasks, *block)
        .join(lists, block, "left")
    )
    # The text of one list is made once for its block.
    one = F.get("lists", F.get("places", F.lit(0)))["text"]
    found = F.flatten(F.transform("places", lambda place: F.get("lists", place)["queries"]))
    cell = F.when(F.size("places") == 1, one).otherwise(F.array_join(F.sort_array(found), joined_by))
    return dealt.select(*map(quote, rows.columns), cell.alias("top_queries"))


def domain_top_queries(
    catalog: Catalog,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
    queries_joined_by: str | None = None,
) -> DataFrame:
    """``id, top_queries``: per namespace the curated queries of its assets, NULL if none.

    One row per namespace, whatever the number of its queries; ``domain_query_sizes`` says how large
    a cell becomes, and ``domain_queries_long`` has the same queries without arrays. With
    ``queries_joined_by`` a cell is one text, the queries as JSON, ordered and joined by that text; it
    is the form for very many queries, as no cell is gathered or moved.
    """
    domain_assets, cards = catalog.require("domain_assets", "knowledge_cards")
    listed = _asset_ids(domain_assets)
    if queries_joined_by is None:
        return _top_queries(listed, cards, ["id"], semantics, tuning)
    every = listed.select("id").distinct()
    return _with_joined_queries(every, listed, cards, ["id"], queries_joined_by, semantics, tuning)


#: How the domain report gives the curated queries of a namespace.
ARRAY, NONE = "array", "none"

#: Rows of a namespace in a report, each with all its queries, that one task makes.
CELL_ROWS = 200


def domain_report(
    catalog: Catalog,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
    top_queries: str = ARRAY,
    queries_joined_by: str | None = None,
) -> DataFrame:
    """Live domains, sub-domains and data products, one row per description card.

    ``top_queries='array'`` puts all curated queries of a namespace into one cell. Nothing bounds
    that list, so with ``'none'`` the column is left out; ``domain_queries_long`` has the queries.
    With ``queries_joined_by`` a cell is one text, as in ``domain_top_queries``.
    """
    if top_queries not in (ARRAY, NONE):
        raise ValueError(f"top_queries must be {ARRAY!r} or {NONE!r}")
    namespaces, cards = catalog.require("namespaces", "knowledge_cards")
    live = namespaces.where("deleted_at IS NULL")
    base = read_for_filter(live, ["id", "last_modified_at"], _INFO_FIELDS).where(
        f"ns_type IN ('{DATA_GROUP}', '{DATA_UNIT}')"
    )
    for side in (
        namespace_references(live, catalog, semantics, tuning),
        domain_asset_names(catalog, semantics, tuning),
    ):
        base = base.join(side, "id", "left")
    if top_queries == ARRAY:
        (domain_assets,) = catalog.require("domain_assets")

        def cells(fanned: DataFrame, hot: DataFrame) -> DataFrame:
            listed, keys = replicate_hot(_asset_ids(domain_assets), "id", hot), ["id", "salt"]
            if queries_joined_by is None:
                found = _top_queries(listed, cards, keys, semantics, tuning)
                return fanned.join(found, keys, "left")
            return _with_joined_queries(
                fanned, listed, cards, keys, queries_joined_by, semantics, tuning
            )

        small = replace(tuning, hot_rows=min(tuning.hot_rows, CELL_ROWS))
        fanned = _fan_out_descriptions(base, cards, live, small, cells)
    else:
        fanned = _fan_out_descriptions(base, cards, live, tuning)
    return fanned.selectExpr(
        *_CLASSES,
        "id AS domain_id",
        "last_modified_at AS last_modified",
        "created_by",
        "ns_created AS created_at",
        "contacts",
        "tags AS asset_tags",
        "coalesce(ns_description, card_description) AS description",
        "followers",
        "assets",
        *(["top_queries"] if top_queries == ARRAY else []),
    )


def domain_descendants(
    domain_assets: DataFrame, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """``ancestor, descendant, depth`` of the namespace hierarchy, one row per pair.

    ``depth`` is the least number of steps; see ``closure.descendants``. A parent that is no node
    itself is no ancestor.
    """
    nodes = domain_assets.selectExpr("_id AS node").distinct()
    listed = domain_assets.where("parent IS NOT NULL").selectExpr("_id AS child", "parent")
    parents = lookup_join(listed.distinct(), nodes, "parent", "node", tuning=tuning)
    return descendants(parents, tuning)
