"""Ids listed in an entity's documents, resolved and gathered back per entity.

``keys`` are the columns that identify an entity row, normally just ``id``. The arrays
gathered here are bounded by the document they come from: an entity lists its tags, followers
and contacts in one cell, and lookups are unique by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.arrays import collect, make_object
from cartulary.functions.jsonx import (
    VALUE,
    Field,
    elements,
    is_variant,
    kept_columns,
    parse_text,
    quote,
    read_fields,
    text_array,
    text_at,
    text_in,
    value_text,
    variant_elements,
)
from cartulary.operators.skew import fits_broadcast, lookup_join
from cartulary.semantics import DEFAULT_TUNING, VARIANT, Semantics, Tuning

ID = ("id",)


def explode_ids(
    df: DataFrame, document: str, name: str, out: str, keys: Sequence[str] = ID
) -> DataFrame:
    """One row per element of a JSON array; entities without elements give no row."""
    return df.selectExpr(*keys, f"explode({text_array(df, document, name)}) AS {out}")


def tag_ids(df: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    return explode_ids(df, "asset_governed_tags", "governedTagIds", "tag_id", keys)


def follower_ids(df: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    return explode_ids(df, "asset_followers", "followedBy", "user_id", keys)


def contacts_long(df: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """One row per contact; an element may be an object or a string that holds one.

    The elements are parsed inside the generator, so the join on their fields adds no parse.
    """
    if is_variant(df, "asset_contacts"):
        contacts = _variant_contacts("asset_contacts")
    else:
        contacts = _text_contacts(text_array(df, "asset_contacts", "contacts"))
    return df.selectExpr(*keys, f"explode({contacts}) AS __contact").selectExpr(
        *keys, "__contact.designation AS designation_id", "__contact.value AS value_id"
    )


def _text_contacts(array: str) -> str:
    """``designation, value`` of each element of an array of texts."""
    return f"transform({array}, e -> {parse_text('e', ['designation', 'value'])})"


def _variant_contacts(document: str) -> str:
    def field(name: str) -> str:
        held = text_in("try_variant_get(e, '$', 'string')", name)
        return f"'{name}', coalesce(try_variant_get(e, '$.{name}', 'string'), {held})"

    contact = f"named_struct({field('designation')}, {field('value')})"
    return f"transform({variant_elements(quote(document), 'contacts', 'variant')}, e -> {contact})"


def search_keywords(users: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """One row per recent search; the keyword is NULL where the search has none."""
    searches = explode_ids(users, "activity", "recentSearches", "__search", keys)
    return searches.selectExpr(*keys, f"{text_in('__search', 'keyword')} AS keyword")


# Columns a lookup of tags and designations may offer.
_RESOURCE_FIELDS = {
    "tag_name": Field("tag_name", "user_defined_resource_info", "name"),
    "tag_description": Field("tag_description", "user_defined_resource_info", "description.text"),
    "designation": Field("designation", "user_defined_resource_info", "name"),
}


def resource_lookup(resources: DataFrame, *columns: str) -> DataFrame:
    """``resource_key`` and the named columns."""
    keyed = resources.selectExpr("CAST(id AS STRING) AS resource_key", "user_defined_resource_info")
    return read_fields(keyed, ["resource_key"], [_RESOURCE_FIELDS[c] for c in columns])


def user_lookup(users: DataFrame, *columns: str, email: str = "email") -> DataFrame:
    """``user_key``, the named plain columns and the email under the given name."""
    keyed = users.selectExpr("CAST(id AS STRING) AS user_key", *columns, "logical_id")
    return read_fields(keyed, ["user_key", *columns], [Field(email, "logical_id", "email")])


def resolve_tags(
    edges: DataFrame,
    resources: DataFrame,
    description: bool = False,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Tag ids that name a resource, with its name; unknown ids vanish."""
    columns = ["tag_name", "tag_description"] if description else ["tag_name"]
    lookup = resource_lookup(resources, *columns)
    return lookup_join(edges, lookup, "tag_id", "resource_key", tuning=tuning)


def resolve_followers(
    edges: DataFrame, users: DataFrame, name: bool = False, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    lookup = user_lookup(users, *(["display_name"] if name else []))
    return lookup_join(edges, lookup, "user_id", "user_key", tuning=tuning)


def resolve_contacts(
    edges: DataFrame,
    resources: DataFrame,
    users: DataFrame,
    name: bool = False,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Contacts whose designation and person are both known."""
    designated = lookup_join(
        edges, resource_lookup(resources, "designation"), "designation_id", "resource_key", tuning=tuning
    )
    lookup = user_lookup(users, *(["display_name"] if name else []))
    return lookup_join(designated, lookup, "value_id", "user_key", tuning=tuning)


def tag_names(
    df: DataFrame,
    resources: DataFrame,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Per entity with a known tag: names of its tags, and how many tags it has.

    The count includes tags without a name, which make a row but no element.
    """
    named = resolve_tags(tag_ids(df, keys), resources, tuning=tuning)
    names = F.expr(f"{collect('tag_name', semantics)} AS tag_names")
    return named.groupBy(*keys).agg(names, F.expr("count(1) AS n_tags"))


def follower_emails(
    df: DataFrame,
    users: DataFrame,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    known = resolve_followers(follower_ids(df, keys), users, tuning=tuning)
    emails = F.expr(f"{collect('email', semantics)} AS asset_followers_emails")
    return known.groupBy(*keys).agg(emails)


def contacts_info(
    df: DataFrame,
    resources: DataFrame,
    users: DataFrame,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    known = resolve_contacts(contacts_long(df, keys), resources, users, tuning=tuning)
    contact = make_object({"email": "email", "designation": "designation"}, semantics)
    return known.groupBy(*keys).agg(
        F.expr(f"{collect(contact, semantics)} AS asset_contacts_info")
    )


def creator_email(
    cards: DataFrame, users: DataFrame, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """Cards whose creator is known: ``id, creator_id, creator_email``."""
    actor = text_at(cards, "knowledge_card_info", "created.actor")
    created = cards.selectExpr("id", f"{actor} AS creator_id")
    emails = user_lookup(users, email="creator_email")
    return lookup_join(created, emails, "creator_id", "user_key", tuning=tuning)


# Documents that list references, with the list's name and its column in a report.
FOLLOWED_BY = Field("asset_followers_followedBy", "asset_followers", "followedBy", VALUE)
CONTACTS = Field("asset_contacts_contacts", "asset_contacts", "contacts", VALUE)
TAG_IDS = Field("asset_governed_tags_governedTagIds", "asset_governed_tags", "governedTagIds", VALUE)
LISTS = (FOLLOWED_BY, CONTACTS, TAG_IDS)

# Kinds of edges.
OWN, TAG, FOLLOWER, CONTACT = "own", "tag", "follower", "contact"


def reference_edges(
    df: DataFrame,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    actor: Field | None = None,
) -> DataFrame:
    """All references of an entity as one stream of rows, each document parsed once.

    ``keys, kind, resource_id, user_id`` and the texts of the three lists. A tag names a resource, a
    follower a user, a contact both. Each entity also has one row of its own, with the texts and,
    where ``actor`` is read, with the user it names.
    """
    parsed, texts, lists = [], {}, {}
    for field in LISTS:
        holder = quote(f"__{field.doc}")
        variant = is_variant(df, field.doc)
        if variant or semantics.json_quoted:
            held = quote(field.doc) if variant else f"try_parse_json({quote(field.doc)})"
            lists[field.column] = variant_elements(holder, field.path)
            if field is CONTACTS:
                lists[field.column] = _variant_contacts(f"__{field.doc}")
        else:
            held = text_at(df, field.doc, field.path)
            lists[field.column] = elements(holder)
            if field is CONTACTS:
                lists[field.column] = _text_contacts(elements(holder))
        parsed.append(f"{held} AS {holder}")
        texts[field.column] = value_text(holder, field, variant, semantics)
    if actor is not None:
        parsed.append(f"{text_at(df, actor.doc, actor.path)} AS __actor")
    none = "CAST(NULL AS STRING)"

    def edge(kind: str, resource: str = none, user: str = none, own: bool = False) -> str:
        held = ", ".join(f"'{name}', {text if own else none}" for name, text in texts.items())
        return f"named_struct('kind', '{kind}', 'resource_id', {resource}, 'user_id', {user}, {held})"

    def edges(array: str, made: str) -> str:
        return f"coalesce(transform({array}, x -> {made}), array())"

    own = edge(OWN, user="__actor" if actor else none, own=True)
    all_edges = ", ".join(
        [
            f"array({own})",
            edges(lists[TAG_IDS.column], edge(TAG, "x")),
            edges(lists[FOLLOWED_BY.column], edge(FOLLOWER, user="x")),
            edges(lists[CONTACTS.column], edge(CONTACT, "x.designation", "x.value")),
        ]
    )
    kept = [quote(k) for k in keys]
    return (
        df.selectExpr(*kept_columns(df, keys), *parsed)
        .selectExpr(*kept, f"explode(concat({all_edges})) AS __edge")
        .selectExpr(*kept, "__edge.*")
    )


def resolved_edges(
    edges: DataFrame,
    resources: DataFrame,
    users: DataFrame,
    resource_columns: Sequence[str] = ("tag_name",),
    user_columns: Sequence[str] = (),
    keys: Sequence[str] = ID,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """``edges`` with the columns of what they name: one look-up for each table.

    ``known_resource`` and ``known_user`` are true where the named row exists.
    """
    for lookup, key, lookup_key, known in (
        (resource_lookup(resources, *resource_columns), "resource_id", "resource_key", "known_resource"),
        (user_lookup(users, *user_columns), "user_id", "user_key", "known_user"),
    ):
        if not fits_broadcast(lookup, tuning):
            # Edges that name no row of this table have a key of their own, so they stay spread.
            alone = f"concat(chr(0), CAST({quote(keys[0])} AS STRING))"
            edges = edges.withColumn(key, F.expr(f"coalesce({key}, {alone})"))
        found = lookup.withColumn(known, F.lit(True))
        edges = lookup_join(edges, found, key, lookup_key, "left", tuning)
    # Edges to unknown rows go before they are gathered.
    return edges.where(" OR ".join(f"({x})" for x in (IS_OWN, IS_TAG, IS_FOLLOWER, IS_CONTACT)))


IS_TAG = f"kind = '{TAG}' AND known_resource"
IS_FOLLOWER = f"kind = '{FOLLOWER}' AND known_user"
IS_CONTACT = f"kind = '{CONTACT}' AND known_resource AND known_user"
IS_OWN = f"kind = '{OWN}'"


def gather(
    edges: DataFrame,
    lists: dict[str, tuple[str, str]],
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    more: Sequence[str] = (),
) -> DataFrame:
    """One row per entity with an array for each of ``lists``, from ``name: (condition, value)``.

    An array is NULL where no edge meets its condition. ``more`` are further aggregates.
    """
    aggregates = [
        expression
        for name, (where, value) in lists.items()
        for expression in (
            f"{collect(value, semantics, where)} AS {name}", f"count_if({where}) AS __n_{name}",
        )
    ]
    grouped = edges.groupBy(*keys).agg(*map(F.expr, [*aggregates, *more]))
    listed = [f"CASE WHEN __n_{name} > 0 THEN {name} END AS {name}" for name in lists]
    counts = [f"__n_{name}" for name in lists]
    rest = [quote(x) for x in grouped.columns if x not in (*keys, *lists, *counts)]
    return grouped.selectExpr(*map(quote, keys), *listed, *rest)


def entity_references(
    df: DataFrame,
    resources: DataFrame,
    users: DataFrame,
    keys: Sequence[str] = ID,
    semantics: Semantics = VARIANT,
    actor: Field | None = None,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Per entity ``tag_names, n_tags, asset_followers_emails, asset_contacts_info``, the texts of
    the three lists, and ``creator_email`` where ``actor`` is read; one shuffle by ``keys``."""
    edges = reference_edges(df, keys, semantics, actor)
    resolved = resolved_edges(edges, resources, users, keys=keys, tuning=tuning)
    contact = make_object({"email": "email", "designation": "tag_name"}, semantics)
    more = [f"count_if({IS_TAG}) AS n_tags"]
    more += [f"max({field.column}) AS {field.column}" for field in LISTS]
    if actor is not None:
        more.append(f"max(email) FILTER (WHERE {IS_OWN}) AS creator_email")
    lists = {
        "tag_names": (IS_TAG, "tag_name"),
        "asset_followers_emails": (IS_FOLLOWER, "email"),
        "asset_contacts_info": (IS_CONTACT, contact),
    }
    return gather(resolved, lists, keys, semantics, more)
