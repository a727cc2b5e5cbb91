"""DuckDB twins of the registered queries.

They say what a query means in the plainest relational form (windows, recursion, one path per
field) and share nothing with the Spark code but the recipes of the derived tables. Arrays
have no order, so both sides show them as sorted text.
"""

from __future__ import annotations

from cartulary.plans.event_catalog import event_properties_by_type, meaning
from oracles.fixtures import EDGE_DOCUMENTS, recipe_sql

NULL_TEXT = "<null>"


def _with(tables: str, ctes: dict[str, str], final: str) -> str:
    parts = {name: recipe_sql(name) for name in tables.split()} | ctes
    listed = ", ".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH RECURSIVE {listed} {final}"


def _at(doc: str, path: str) -> str:
    return f"json_extract_string({doc}, '$.{path}')"


def _json_at(doc: str, path: str) -> str:
    return f"CAST(json_extract({doc}, '$.{path}') AS VARCHAR)"


def _object(**fields: str) -> str:
    pairs = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CAST(json_merge_patch('{{}}', json_object({pairs})) AS VARCHAR)"


def _object_with_nulls(**fields: str) -> str:
    pairs = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CAST(json_object({pairs}) AS VARCHAR)"


def _show(listing: str) -> str:
    return f"array_to_string(list_sort({listing}), '|')"


def _gather(value: str) -> str:
    """Sorted text of the non-null values of a group; empty text when there are none."""
    return _show(f"coalesce(list({value}) FILTER (WHERE {value} IS NOT NULL), [])")


def _gather_with_nulls(value: str) -> str:
    return _show(f"list(coalesce({value}, '{NULL_TEXT}'))")


def _elements(table: str, doc: str, name: str, kind: str = "VARCHAR", key: str = "id") -> str:
    return (
        f"SELECT {key} AS eid, unnest(from_json(json_extract({doc}, '$.{name}'), "
        f"""'["{kind}"]')) AS ref FROM {table}"""
    )


def _links(table: str) -> dict[str, str]:
    """Tags, followers and contacts of one table, before and after their lookups."""
    return {
        "tag_link": _elements(table, "asset_governed_tags", "governedTagIds"),
        "tag_hit": (
            f"SELECT eid, ref, {_at('user_defined_resource_info', 'name')} AS tag_name, "
            f"{_at('user_defined_resource_info', 'description.text')} AS tag_text "
            "FROM tag_link, user_defined_resource r WHERE ref = r.id"
        ),
        "follow_link": _elements(table, "asset_followers", "followedBy"),
        "follow_hit": (
            f"SELECT eid, display_name, {_at('logical_id', 'email')} AS email "
            "FROM follow_link, users WHERE ref = users.id"
        ),
        "contact_any": _elements(table, "asset_contacts", "contacts", "JSON"),
        "contact_doc": (
            "SELECT eid, CASE WHEN json_type(ref) = 'VARCHAR' "
            "THEN CAST(json_extract_string(ref, '$') AS JSON) ELSE ref END AS doc FROM contact_any"
        ),
        "contact_link": (
            f"SELECT eid, {_at('doc', 'designation')} AS designation_id, "
            f"{_at('doc', 'value')} AS value_id FROM contact_doc"
        ),
        "contact_hit": (
            f"SELECT eid, display_name, {_at('logical_id', 'email')} AS email, "
            f"{_at('user_defined_resource_info', 'name')} AS designation "
            "FROM contact_link, user_defined_resource r, users "
            "WHERE designation_id = r.id AND value_id = users.id"
        ),
    }


def _gathered(table: str, nulls: bool = False) -> dict[str, str]:
    gather = _gather_with_nulls if nulls else _gather
    make = _object_with_nulls if nulls else _object
    contact = make(email="email", designation="designation")
    return _links(table) | {
        "follow_list": f"SELECT eid, {gather('email')} AS emails FROM follow_hit GROUP BY eid",
        "contact_list": f"SELECT eid, {gather(contact)} AS infos FROM contact_hit GROUP BY eid",
    }


LOOKUPS = "users user_defined_resource"


def _entity(
    table: str,
    columns: list[str],
    *,
    nulls: bool = False,
    by_asset: bool = False,
    more: dict[str, str] | None = None,
    joins: str = "",
) -> str:
    """An enrichment report with the tag names as a window over the joined rows."""
    if nulls:
        names = (
            f"CASE WHEN tn.eid IS NULL THEN '{NULL_TEXT}' ELSE "
            f"array_to_string(list_sort(list(coalesce(tn.tag_name, '{NULL_TEXT}')) "
            "OVER (PARTITION BY tn.eid)), '|') END"
        )
    else:
        names = (
            "array_to_string(list_sort(coalesce(list(tn.tag_name) "
            "FILTER (WHERE tn.tag_name IS NOT NULL) OVER (PARTITION BY tn.eid), [])), '|')"
        )
    selected = ", ".join([
        *columns,
        "fl.emails AS asset_followers_emails",
        "cl.infos AS asset_contacts_info",
        f'{names} AS "governedTagIds_tag_names"',
    ])
    distinct = "DISTINCT " if by_asset else ""
    return _with(
        f"{table} {LOOKUPS}" if table != "users" else LOOKUPS,
        _gathered(table, nulls) | (more or {}),
        f"SELECT {distinct}{selected} FROM {table} d LEFT JOIN tag_hit tn ON d.id = tn.eid "
        f"LEFT JOIN follow_list fl ON d.id = fl.eid LEFT JOIN contact_list cl ON d.id = cl.eid {joins}",
    )


def _named(doc: str, path: str, name: str, quoted: bool = False) -> str:
    value = _json_at(f"d.{doc}", path) if quoted else _at(f"d.{doc}", path)
    return f'{value} AS "{name}"'


def _reference_columns(quoted: bool = False) -> list[str]:
    return [
        _named("asset_followers", "followedBy", "asset_followers_followedBy", quoted),
        _named("asset_contacts", "contacts", "asset_contacts_contacts", quoted),
        _named("asset_governed_tags", "governedTagIds", "asset_governed_tags_governedTagIds", quoted),
    ]


AUDIT = ["d._created_at", "d.last_modified_at", "d.last_ingested_at"]


def _dataset_columns(quoted: bool = False) -> list[str]:
    return [
        "d.id", "d.entity_type", *AUDIT,
        _named("logical_id", "name", "logical_id_name"),
        _named("logical_id", "platform", "logical_id_platform"),
        _named("schema", "description", "schema_description"),
        _named("schema", "entityId", "schema_entityId"),
        _named("schema", "fields", "schema_fields", quoted),
        _named("schema", "sqlSchema.materialization", "schema_sqlSchema_materialization"),
        _named("structure", "database", "structure_database"),
        _named("structure", "schema", "structure_schema"),
        _named("structure", "table", "structure_table"),
        _named("statistics", "dataSizeBytes", "statistics_dataSizeBytes"),
        _named("statistics", "lastUpdated", "statistics_lastUpdated"),
        _named("statistics", "recordCount", "statistics_recordCount"),
        _named("source_info", "mainUrl", "source_info_mainUrl"),
        _named("entity_upstream", "sourceDatasets", "upstream_sourceDatasets", quoted),
        *_reference_columns(quoted),
        _named("custom_metadata", "metadata", "custom_metadata_metadata", quoted),
    ]


def _raw(*names: str) -> list[str]:
    return [f"d.{name}" for name in names]


RAW_REFERENCES = ("asset_followers", "asset_contacts", "asset_governed_tags")


def _dashboard_columns(quoted: bool = False) -> list[str]:
    return [
        "d.id", "d.entity_type", *AUDIT,
        *_raw("source_info", "logical_id", "entity_upstream", "dashboard_info", "structure"),
        *_raw(*RAW_REFERENCES),
        _named("dashboard_info", "description", "dashboard_info_description", quoted),
        _named("dashboard_info", "powerBi.powerBiDashboardType", "dashboard_powerBI", quoted),
        *_reference_columns(quoted),
        _named("structure", "name", "structure_name", quoted),
        _named("structure", "directories", "structure_directories", quoted),
    ]


def _view_columns(quoted: bool = False) -> list[str]:
    return [
        "d.id", "d.entity_type", *AUDIT, *_raw("logical_id", "structure", *RAW_REFERENCES),
        _named("logical_id", "name", "name"),
        *_reference_columns(quoted),
        _named("structure", "name", "structure_name", quoted),
        _named("structure", "directories", "structure_directories", quoted),
    ]


def _card_report(nulls: bool = False) -> str:
    creator = (
        f"SELECT k.id AS eid, {_at('k.knowledge_card_info', 'created.actor')} AS creator_id, "
        f"{_at('u.logical_id', 'email')} AS creator_email FROM knowledge_cards k, users u "
        f"WHERE {_at('k.knowledge_card_info', 'created.actor')} = u.id"
    )
    columns = [
        "d.id", "d._created_at", "d.last_modified_at", *_raw(*RAW_REFERENCES),
        _named("knowledge_card_info", "created.actor", "created_by", nulls),
        *_reference_columns(nulls)[1:],
        "c.creator_email",
    ]
    return _entity(
        "knowledge_cards", columns, nulls=nulls,
        more={"creator": creator}, joins="LEFT JOIN creator c ON d.id = c.eid",
    )


def _user_report(nulls: bool = False) -> str:
    gather = _gather_with_nulls if nulls else _gather
    searches = _elements("users", "activity", "recentSearches", "JSON")
    words = f"SELECT eid, {gather(_at('ref', 'keyword'))} AS words FROM searches GROUP BY eid"
    return _with(
        LOOKUPS,
        _gathered("users", nulls) | {"searches": searches, "word_list": words},
        "SELECT d.id, d.display_name, d._created_at, d.last_modified_at, "
        f"{_at('d.logical_id', 'email')} AS email, {_at('d.properties', 'role')} AS role, "
        "d.properties, d.activity, d.asset_followers, fl.emails AS asset_followers_emails, "
        "w.words AS recent_searches_keywords FROM users d "
        "LEFT JOIN word_list w ON d.id = w.eid LEFT JOIN follow_list fl ON d.id = fl.eid",
    )


_INFO = "knowledge_card_info"
_CARD_TEXT = _at(f"k.{_INFO}", "detail.assetDescription.description")

_DESCRIPTIONS = {
    "described": (
        f"SELECT {_at(f'k.{_INFO}', 'anchorEntityId')} AS anchor, {_CARD_TEXT} AS body, "
        f"{_at('u.logical_id', 'email')} AS author FROM knowledge_cards k "
        f"LEFT JOIN users u ON {_at(f'k.{_INFO}', 'created.actor')} = u.id "
        f"WHERE {_at(f'k.{_INFO}', 'detail.type')} = 'ASSET_DESCRIPTION'"
    ),
    "pieces": (
        "SELECT d.id AS eid, CASE WHEN "
        f"{_at('d.schema', 'description')} <> '' THEN "
        f"{_object(description=_at('d.schema', 'description'), source=_at('d.logical_id', 'platform'))} END AS own, "
        f"CASE WHEN c.body IS NOT NULL THEN {_object(description='c.body', source='c.author')} END AS told, "
        "FROM datasets d LEFT JOIN described c ON d.id = c.anchor"
    ),
    "merged": (
        "SELECT eid, CASE WHEN own IS NOT NULL OR told IS NOT NULL "
        "THEN '[' || concat_ws(',', own, told) || ']' END AS descriptions FROM pieces"
    ),
}


def _curated(once: bool = False) -> str:
    kept = [c for c in _dataset_columns() if "schema_description" not in c and "custom_metadata" not in c]
    window = (
        "list(tn.tag_name) FILTER (WHERE tn.tag_name IS NOT NULL) OVER (PARTITION BY tn.eid)"
    )
    joined = (
        "FROM datasets d LEFT JOIN tag_hit tn ON d.id = tn.eid "
        "LEFT JOIN follow_list fl ON d.id = fl.eid LEFT JOIN contact_list cl ON d.id = cl.eid "
        "LEFT JOIN merged m ON d.id = m.eid"
    )
    condition = f"{_at('d.schema', 'fields')} IS NOT NULL AND d.is_non_prod = FALSE"
    shared = [*kept, "d.is_non_prod", "m.descriptions AS schema_description",
              "fl.emails AS asset_followers_emails", "cl.infos AS asset_contacts_info"]
    ctes = _gathered("datasets") | _DESCRIPTIONS
    if once:
        ctes |= {
            "names": f"SELECT eid, {_gather('tag_name')} AS names FROM tag_hit GROUP BY eid",
            "amounts": "SELECT anchor, count(*) AS n_cards FROM described GROUP BY anchor",
        }
        listed = ", ".join([*shared, "coalesce(nm.names, '') AS \"governedTagIds_tag_names\"", "a.n_cards"])
        joined = joined.replace("LEFT JOIN tag_hit tn ON d.id = tn.eid", "LEFT JOIN names nm ON d.id = nm.eid")
        joined += " LEFT JOIN amounts a ON d.id = a.anchor"
    else:
        listed = ", ".join([*shared, f'{_show(f"coalesce({window}, [])")} AS "governedTagIds_tag_names"'])
    return _with(
        f"datasets knowledge_cards {LOOKUPS}", ctes,
        f"SELECT {listed} {joined} WHERE {condition}",
    )


_LISTED = {
    "tree": (
        "SELECT _id AS id, parent, list_concat(CASE WHEN live_csv IS NULL THEN NULL ELSE string_split(live_csv, ',') END, "
        "string_split(selected_csv, ',')) AS assets, live_csv FROM domain_assets"
    ),
    "walk": (
        "SELECT id, parent, assets, live_csv FROM tree UNION ALL "
        "SELECT t.id, t.parent, t.assets, t.live_csv FROM tree t JOIN walk w ON w.id = t.parent"
    ),
    "details": (
        "SELECT DISTINCT w.id, w.parent, unnest(w.assets) AS asset FROM walk w WHERE live_csv IS NOT NULL"
    ),
}

_ASSET_OBJECT = _object(
    asset_id="x.asset",
    name=(
        f"coalesce({_at('b.dashboard_info', 'title')}, {_at('s.logical_id', 'name')}, "
        f"{_at('v.structure', 'name')})"
    ),
    workspace=f"nullif({_at('b.logical_id', 'platform')}, '')",
)

_ASSET_NAMES = _LISTED | {
    "asset_list": (
        f"SELECT x.id AS eid, {_gather(_ASSET_OBJECT)} AS assets FROM details x "
        "LEFT JOIN dashboards b ON x.asset = b.id LEFT JOIN datasets s ON x.asset = s.id "
        "LEFT JOIN virtual_views v ON x.asset = v.id GROUP BY x.id"
    )
}

_QUERY_HIT = {
    "query_hit": (
        f"SELECT x.id AS eid, x.asset, k.id AS card_id, {_at(f'k.{_INFO}', 'detail.query.title')} AS title, "
        f"{_at(f'k.{_INFO}', 'detail.query.explanations[0].explanation')} AS explanation, "
        f"{_at(f'k.{_INFO}', 'detail.query.query')} AS query FROM details x LEFT JOIN knowledge_cards k "
        f"ON x.asset = {_at(f'k.{_INFO}', 'anchorEntityId')} "
        f"AND {_at(f'k.{_INFO}', 'detail.type')} = 'QUERY_DESCRIPTION' AND k.deleted_at IS NULL "
        f"AND {_at(f'k.{_INFO}', 'detail.query.isMarkedAsCurated')} = 'true'"
    ),
}
_QUERY_OBJECT = _object(title="title", explanation="explanation", query="query")
_TOP_QUERIES = _QUERY_HIT | {
    "query_list": (
        f"SELECT eid, nullif({_gather(f'nullif({_QUERY_OBJECT}, {chr(39)}{{}}{chr(39)})')}, '') AS top_queries "
        "FROM query_hit GROUP BY eid"
    )
}

_PERSON = _object(name="display_name", email="email")
_NS = _links("namespaces") | {
    "tag_list": (
        f"SELECT eid, {_gather(_object(tag_id='ref', tag_name='tag_name', tag_description='tag_text'))} AS tags "
        "FROM tag_hit GROUP BY eid"
    ),
    "follow_list": f"SELECT eid, {_gather(_PERSON)} AS followers FROM follow_hit GROUP BY eid",
    "contact_list": f"SELECT eid, {_gather(_PERSON)} AS contacts FROM contact_hit GROUP BY eid",
    "creator_list": (
        f"SELECT n.id AS eid, {_gather(_object(name='u.display_name', email=_at('u.logical_id', 'email')))} AS created_by "
        f"FROM namespaces n LEFT JOIN users u ON {_at('n.namespace_info', 'created.actor')} = u.id GROUP BY n.id"
    ),
}
_NS_TEXT = {
    "texts": (
        f"SELECT n.id AS eid, coalesce({_at('n.namespace_info', 'description.text')}, {_CARD_TEXT}) AS description "
        f"FROM namespaces n LEFT JOIN knowledge_cards k ON n.id = {_at(f'k.{_INFO}', 'anchorEntityId')} "
        f"AND {_CARD_TEXT} IS NOT NULL"
    )
}


def _classes() -> str:
    kind = _at("n.namespace_info", "detail.type")
    name = _at("n.namespace_info", "name")
    parent = _at("n.namespace_info", "parentId")
    return (
        f"CASE WHEN {kind} = 'DATA_GROUP' AND {parent} IS NULL THEN {name} ELSE '' END AS domain_name, "
        f"CASE WHEN {kind} = 'DATA_GROUP' AND {parent} IS NOT NULL THEN {name} ELSE '' END AS subdomain_name, "
        f"CASE WHEN {kind} = 'DATA_UNIT' THEN {name} ELSE '' END AS data_product_name, n.id AS domain_id"
    )


def _popular(event_type: str, column: str, top: int | None = None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return _with(
        "usage_events", {},
        f'SELECT {column} AS "{column.upper()}", count(*) AS "COUNT" FROM usage_events '
        f"WHERE event_type = '{event_type}' GROUP BY {column} ORDER BY count(*) DESC, {column} NULLS FIRST{limit}",
    )


def _properties(event_type: str, *columns: str) -> str:
    listed = ", ".join(f'{c} AS "{c.upper()}"' for c in columns)
    return _with(
        "usage_events", {}, f"SELECT {listed} FROM usage_events WHERE event_type = '{event_type}'"
    )


# What each field of the edge documents reads as, by their place; a text not listed is NULL.
_N = "CAST(p_partkey AS VARCHAR)"
_EDGE_VALUES = {
    "a": {
        0: "'x'", 1: f"'last' || {_N}", 2: f"'x' || {_N}", 5: f"'q' || chr(34) || 'A' || chr(10) || {_N}",
        8: f"""'{{"k":[1,' || {_N} || ']}}'""", 10: "'1.5'",
    },
    "c": {0: _N, 1: "'2'", 10: "'true'", 14: f"'y' || {_N}"},
    "list": {0: """'[1,"z",{"k":2}]'""", 5: "'[]'", 8: "'none'", 10: "'[null,1000.0]'"},
    "elements": {0: """'1|z|{"k":2}'""", 5: "''", 10: f"'1000.0|{NULL_TEXT}'"},
}
_EDGE_VALUES["a_alone"] = _EDGE_VALUES["a"]
# A document with a repeated key is no variant.
_EDGE_VALUES["v_a"] = {k: v for k, v in _EDGE_VALUES["a"].items() if k != 1}
_EDGE_VALUES["v_list"] = _EDGE_VALUES["list"]


def _edge_cases() -> str:
    columns = [
        f"CASE p_partkey % {len(EDGE_DOCUMENTS)} "
        + " ".join(f"WHEN {k} THEN {value}" for k, value in by_place.items())
        + f" END AS {name}"
        for name, by_place in _EDGE_VALUES.items()
    ]
    return f"SELECT p_partkey AS id, {', '.join(columns)} FROM part"


def _of_type(name: str) -> str:
    prefix, bracket, _ = name.partition("[")
    kept = f"starts_with(event_type, '{prefix}')" if bracket else f"event_type = '{name}'"
    return f"FROM profile_events WHERE {kept}"


def _event_values() -> str:
    parts = [
        f"SELECT event_id, '{name}' AS \"EVENT_TYPE\", '{p}' AS \"PROPERTY\", '{p.upper()}' AS \"COLUMN_NAME\", "
        f"{p} AS \"VALUE\" {_of_type(name)} AND {p} IS NOT NULL"
        for name, properties in event_properties_by_type().items()
        for p in properties
    ]
    return _with("profile_events", {}, " UNION ALL ".join(parts))


def _event_profile() -> str:
    """Each type and property apart, from the plain table."""
    table = event_properties_by_type()
    parts = []
    for name, properties in table.items():
        rows = _of_type(name)
        head = f"SELECT '{name}' AS \"EVENT_TYPE\", '{meaning(name)}' AS \"DESCRIPTION\", "
        for p in properties:
            samples = ", ".join(f"arg_min({p}, md5('{k}' || {p}))" for k in range(3))
            shown = f"coalesce({_show(f'list_distinct([{samples}])')}, '')"
            parts.append(
                f"{head}'{p}' AS \"PROPERTY\", '{p.upper()}' AS \"COLUMN_NAME\", count(*) AS \"EVENTS\", "
                f"count({p}) AS \"FILLED\", {shown} AS \"SAMPLE_VALUES\" {rows}"
            )
        if not properties:
            parts.append(
                f"{head}NULL AS \"PROPERTY\", NULL AS \"COLUMN_NAME\", count(*) AS \"EVENTS\", "
                f"0 AS \"FILLED\", '' AS \"SAMPLE_VALUES\" {rows}"
            )
    return _with("profile_events", {}, " UNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    dataset_links = _links("datasets")
    domain_report = _with(
        f"namespaces domain_assets knowledge_cards dashboards datasets virtual_views {LOOKUPS}",
        _NS | _NS_TEXT | _ASSET_NAMES | _TOP_QUERIES,
        f"SELECT {_classes()}, n.last_modified_at AS last_modified, c.created_by, "
        f"{_at('n.namespace_info', 'created.time')} AS created_at, k.contacts, t.tags AS asset_tags, "
        "x.description, f.followers, a.assets, q.top_queries FROM namespaces n "
        "LEFT JOIN tag_list t ON n.id = t.eid LEFT JOIN follow_list f ON n.id = f.eid "
        "LEFT JOIN contact_list k ON n.id = k.eid LEFT JOIN creator_list c ON n.id = c.eid "
        "LEFT JOIN asset_list a ON n.id = a.eid LEFT JOIN texts x ON n.id = x.eid "
        "LEFT JOIN query_list q ON n.id = q.eid "
        f"WHERE n.deleted_at IS NULL AND {_at('n.namespace_info', 'detail.type')} IN ('DATA_GROUP', 'DATA_UNIT')",
    )
    return {
        # usage
        "sample_events": _with(
            "usage_events", {}, "SELECT least(5, count(*)) AS n_events FROM usage_events"
        ),
        "popular_queries": _popular("Search search attempted", "query"),
        "popular_filters": _popular("Search search attempted", "selectedfacets"),
        "sign_in_providers": _popular("General sign_in attempted", "identity_provider"),
        "top_sign_in_users": _popular("General sign_in attempted", "email"),
        "top_semantic_search_users": _popular("Search semantic search attempted", "email"),
        "popularity_topk": _popular("Engagement saved_search created", "keyword", 5),
        "saved_searches": _properties(
            "Engagement saved_search created", "name", "keyword", "context", "facetsjson"
        ),
        "semantic_searches": _properties(
            "Search semantic search attempted", "qaresponse", "searchresults"
        ),
        "event_properties": _properties(
            "Search semantic search attempted", "query", "qaresponse", "searchresults"
        ),
        "event_type_properties": _with(
            "usage_events",
            {
                "listed": (
                    "SELECT * FROM (VALUES ('General sign_in attempted', 'identity_provider'), "
                    "('Search search attempted', 'query'), ('Search search attempted', 'context'), "
                    "('Search search attempted', 'interaction'), ('Search search attempted', 'latency'), "
                    "('Search search attempted', 'facets'), ('Search search attempted', 'selectedFacets'), "
                    "('Search search attempted', 'selectedFilters'), "
                    "('Search semantic search attempted', 'query'), "
                    "('Search semantic search attempted', 'qaResponse'), "
                    "('Search semantic search attempted', 'searchResults'), "
                    "('Engagement saved_search created', 'name'), "
                    "('Engagement saved_search created', 'keyword'), "
                    "('Engagement saved_search created', 'context'), "
                    "('Engagement saved_search created', 'facetsJSON')) AS l(kind, property)"
                )
            },
            'SELECT event_type AS "EVENT_TYPE", count(*) AS "EVENTS", property AS "PROPERTY", '
            'upper(property) AS "COLUMN_NAME" FROM usage_events LEFT JOIN listed ON kind = event_type '
            "GROUP BY event_type, property",
        ),
        "event_profile": _event_profile(),
        "event_values": _event_values(),
        "event_properties_template": _with(
            "profile_events", {},
            f'SELECT hash AS "HASH", query AS "QUERY" {_of_type("PageViewEvent [page name]")}',
        ),
        "event_ranking": _with(
            "usage_events", {},
            "SELECT query AS \"QUERY\", count(*) AS \"COUNT\", row_number() OVER (ORDER BY count(*) DESC, query NULLS FIRST) AS \"RANK\" "
            "FROM usage_events WHERE event_type = 'Search search attempted' GROUP BY query",
        ),
        "popular_queries_stored": _popular("Search search attempted", "query"),
        # documents
        "json_edge_cases": _edge_cases(),
        # references
        "explode_tags": _with("datasets", {"l": _elements("datasets", "asset_governed_tags", "governedTagIds")},
                              "SELECT eid AS id, ref AS tag_id FROM l"),
        "explode_followers": _with("datasets", {"l": _elements("datasets", "asset_followers", "followedBy")},
                                   "SELECT eid AS id, ref AS user_id FROM l"),
        "resolve_tags": _with(f"datasets {LOOKUPS}", dataset_links,
                              "SELECT eid AS id, ref AS tag_id, tag_name, tag_text AS tag_description FROM tag_hit"),
        "tag_names": _with(f"datasets {LOOKUPS}", dataset_links,
                           f"SELECT eid AS id, {_gather('tag_name')} AS tag_names, count(*) AS n_tags FROM tag_hit GROUP BY eid"),
        "followers_emails": _with(f"datasets {LOOKUPS}", _gathered("datasets"),
                                  "SELECT eid AS id, emails AS asset_followers_emails FROM follow_list"),
        "contacts_long": _with(f"knowledge_cards {LOOKUPS}", _links("knowledge_cards"),
                               "SELECT eid AS id, designation_id, value_id FROM contact_link"),
        "contacts_info": _with(f"datasets {LOOKUPS}", _gathered("datasets"),
                               "SELECT eid AS id, infos AS asset_contacts_info FROM contact_list"),
        "creator_email": _with(
            "knowledge_cards users", {},
            f"SELECT k.id, u.id AS creator_id, {_at('u.logical_id', 'email')} AS creator_email "
            f"FROM knowledge_cards k JOIN users u ON {_at('k.knowledge_card_info', 'created.actor')} = u.id",
        ),
        "search_keywords": _with(
            "users", {"s": _elements("users", "activity", "recentSearches", "JSON")},
            f"SELECT eid AS id, {_at('ref', 'keyword')} AS keyword FROM s",
        ),
        "tag_window_grain": _entity("datasets", ["d.id"]),
        "tag_asset_grain": _entity("datasets", ["d.id"], by_asset=True),
        # entity reports
        "dataset_report": _entity("datasets", _dataset_columns()),
        "dataset_report_by_asset": _entity("datasets", _dataset_columns(), by_asset=True),
        "dataset_report_variant_input": _entity("datasets", _dataset_columns()),
        "dataset_report_stored": _entity("datasets", _dataset_columns()),
        "dataset_report_typed": (
            "SELECT *, TRY_CAST(statistics_dataSizeBytes AS BIGINT) AS data_size_bytes, "
            "TRY_CAST(statistics_recordCount AS BIGINT) AS record_count "
            f"FROM ({_entity('datasets', _dataset_columns(), by_asset=True)})"
        ),
        "dataset_report_presto": _entity("datasets", _dataset_columns(True), nulls=True),
        "dashboard_report": _entity("dashboards", _dashboard_columns()),
        "dashboard_report_presto": _entity("dashboards", _dashboard_columns(True), nulls=True),
        "virtual_view_report": _entity("virtual_views", _view_columns()),
        "virtual_view_report_presto": _entity("virtual_views", _view_columns(True), nulls=True),
        "knowledge_card_report": _card_report(),
        "knowledge_card_report_presto": _card_report(nulls=True),
        "knowledge_card_report_variant_input": _card_report(),
        "user_report": _user_report(),
        "user_report_variant_input": _user_report(),
        "user_report_presto": _user_report(nulls=True),
        # curated datasets
        "merged_descriptions": _with(
            "datasets knowledge_cards users", _DESCRIPTIONS, "SELECT eid AS id, descriptions FROM merged"
        ),
        "curated_dataset_report": _curated(),
        "curated_dataset_report_once": _curated(once=True),
        "curated_dataset_places": (
            "SELECT *, row_number() OVER (ORDER BY schema_description NULLS LAST, id) AS place "
            f"FROM ({_curated(once=True)})"
        ),
        # domains
        "domain_classification": _with("namespaces", {}, f"SELECT {_classes()} FROM namespaces n"),
        "domain_asset_details": _with(
            "namespaces domain_assets", _LISTED,
            f"SELECT x.id, {_at('n.namespace_info', 'name')} AS name, x.parent, x.asset "
            "FROM details x LEFT JOIN namespaces n ON x.id = n.id",
        ),
        "domain_asset_names": _with(
            "domain_assets dashboards datasets virtual_views", _ASSET_NAMES,
            "SELECT eid AS id, assets FROM asset_list",
        ),
        "domain_descendants": _with(
            "domain_assets",
            {
                "up": (
                    "SELECT a.parent AS ancestor, a._id AS descendant, 1 AS depth FROM domain_assets a "
                    "WHERE a.parent IN (SELECT _id FROM domain_assets) AND a.parent <> a._id UNION ALL "
                    "SELECT p.parent, up.descendant, up.depth + 1 FROM up JOIN domain_assets p ON p._id = up.ancestor "
                    "WHERE p.parent IN (SELECT _id FROM domain_assets) AND p.parent <> p._id"
                )
            },
            "SELECT ancestor, descendant, min(depth) AS depth FROM up GROUP BY ALL",
        ),
        "graph_descendants": _with(
            "hierarchy",
            {
                "up": (
                    "SELECT parent AS ancestor, _id AS descendant, 1 AS depth FROM hierarchy WHERE parent IS NOT NULL "
                    "UNION SELECT h.parent, up.descendant, up.depth + 1 FROM up JOIN hierarchy h ON h._id = up.ancestor "
                    "WHERE h.parent IS NOT NULL AND up.depth < 20"
                )
            },
            "SELECT ancestor, descendant, min(depth) AS depth FROM up "
            "WHERE ancestor <> descendant AND ancestor IN (SELECT _id FROM hierarchy) GROUP BY ALL",
        ),
        "domain_tags": _with(f"namespaces {LOOKUPS}", _NS, "SELECT eid AS id, tags FROM tag_list"),
        "domain_followers": _with(f"namespaces {LOOKUPS}", _NS, "SELECT eid AS id, followers FROM follow_list"),
        "domain_contacts": _with(f"namespaces {LOOKUPS}", _NS, "SELECT eid AS id, contacts FROM contact_list"),
        "domain_creator": _with(f"namespaces {LOOKUPS}", _NS, "SELECT eid AS id, created_by FROM creator_list"),
        "domain_description": _with("namespaces knowledge_cards", _NS_TEXT, "SELECT eid AS id, description FROM texts"),
        "domain_queries_long": _with(
            "domain_assets knowledge_cards", _LISTED | _QUERY_HIT,
            "SELECT eid AS id, asset, card_id, title, explanation, query FROM query_hit WHERE card_id IS NOT NULL",
        ),
        "domain_top_queries": _with(
            "domain_assets knowledge_cards", _LISTED | _TOP_QUERIES,
            "SELECT eid AS id, top_queries FROM query_list",
        ),
        "domain_query_sizes": _with(
            "domain_assets knowledge_cards", _LISTED | _QUERY_HIT,
            "SELECT eid AS id, count(*) AS n_queries, CAST(sum(coalesce(strlen(title), 0) + "
            "coalesce(strlen(explanation), 0) + coalesce(strlen(query), 0)) AS BIGINT) AS n_bytes "
            "FROM query_hit WHERE card_id IS NOT NULL GROUP BY eid",
        ),
        "domain_report": domain_report,
        "domain_report_variant_input": domain_report,
    }
