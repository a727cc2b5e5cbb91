"""Catalog and event tables derived from the driver's test tables.

Each recipe is a select list over one test table, written so that Spark and DuckDB read it the
same way. The JSON documents hold the awkward cases on purpose: missing and empty lists, ids
that match nothing, contacts as strings, empty and null descriptions, soft-deleted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.plans.event_catalog import event_properties_by_type
from cartulary.sources.catalog import Catalog, table_names


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _followers(key: str, *moduli: int, extra: str = "") -> str:
    ids = """ || '","PERSON~' || """.join(_text(f"{key} % {m}") for m in moduli)
    return f"""'{{"followedBy":["PERSON~' || {ids} || '"{extra}]}}'"""


def _tags(key: str, *moduli: int, extra: str = "") -> str:
    ids = """ || '","USER_DEFINED_RESOURCE~' || """.join(_text(f"{key} % {m}") for m in moduli)
    return f"""'{{"governedTagIds":["USER_DEFINED_RESOURCE~' || {ids} || '"{extra}]}}'"""


def _contact(key: str, person: str) -> str:
    return (
        f"""'{{"contacts":[{{"designation":"USER_DEFINED_RESOURCE~' || {_text(f"{key} % 30")}"""
        f""" || '","value":"PERSON~' || {_text(person)} || '"}}]}}'"""
    )


def _contact_as_string(key: str, person: str) -> str:
    """The same contact, with the element a string that holds the object."""
    quote = r'\"'
    # A backslash written by code point, since the two engines read it differently in a literal.
    contact = (
        f"""'{{"contacts":["{{{quote}designation{quote}:{quote}USER_DEFINED_RESOURCE~' || """
        f"""{_text(f"{key} % 30")} || '{quote},{quote}value{quote}:{quote}PERSON~' || """
        f"""{_text(person)} || '{quote}}}"]}}'"""
    )
    return contact.replace("\\", "' || chr(92) || '")


def _audit(key: str, *names: str) -> str:
    return ", ".join(
        f"TIMESTAMP '2024-01-01 00:00:00' + ({key} % {300 + i}) * INTERVAL '1' DAY AS {name}"
        for i, name in enumerate(names)
    )


_USERS = f"""
'PERSON~' || CAST(c_custkey AS STRING) AS id, c_name AS display_name,
CASE WHEN c_custkey % 17 = 0 THEN '{{}}'
     ELSE '{{"email":"u' || CAST(c_custkey AS STRING) || '@example.com"}}' END AS logical_id,
'{{"role":"' || c_mktsegment || '"}}' AS properties,
CASE WHEN c_custkey % 5 = 0 THEN NULL
     ELSE '{{"recentSearches":[{{"keyword":"k' || CAST(c_custkey % 11 AS STRING)
          || '"}},{{"other":1}},{{"keyword":"k' || CAST(c_custkey % 3 AS STRING) || '"}}]}}' END AS activity,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {_followers("c_custkey", 29, 34)} END AS asset_followers,
c_acctbal AS acctbal,
{_audit("c_custkey", "_created_at", "last_modified_at")}
"""

_RESOURCES = """
'USER_DEFINED_RESOURCE~' || CAST(n_nationkey AS STRING) AS id,
CASE WHEN n_nationkey = 7 THEN '{"description":{"text":"no name"}}'
     ELSE '{"name":"' || n_name || '","description":{"text":"region '
          || CAST(n_regionkey AS STRING) || '"}}' END AS user_defined_resource_info
"""

_DATASETS = f"""
'DATASET~' || CAST(p_partkey AS STRING) AS id, 'DATASET' AS entity_type,
CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 5 = 0 END AS is_non_prod,
'{{"name":"' || p_name || '","platform":"' || p_type || '"}}' AS logical_id,
CASE WHEN p_partkey % 6 = 0 THEN '{{"description":"","entityId":"E1"}}'
     WHEN p_partkey % 6 = 1 THEN '{{"description":null,"fields":[]}}'
     ELSE '{{"description":"about ' || p_name || '","entityId":"E' || CAST(p_partkey AS STRING)
          || '","fields":[{{"fieldPath":"a"}},{{"fieldPath":"b"}}],"sqlSchema":{{"materialization":"TABLE"}}}}'
     END AS schema,
'{{"database":"db' || CAST(p_size AS STRING) || '","schema":"s","table":"t' || CAST(p_partkey AS STRING) || '"}}' AS structure,
'{{"dataSizeBytes":' || CAST(p_partkey * 1000 AS STRING) || ',"recordCount":' || CAST(p_partkey AS STRING) || '}}' AS statistics,
'{{"mainUrl":"https://example.com/' || CAST(p_partkey AS STRING) || '"}}' AS source_info,
'{{"sourceDatasets":["DATASET~' || CAST(p_partkey % 13 AS STRING) || '"]}}' AS entity_upstream,
CASE WHEN p_partkey % 4 = 0 THEN NULL
     ELSE {_followers("p_partkey", 34, 97, extra=',"PERSON~missing"')} END AS asset_followers,
CASE WHEN p_partkey % 5 = 0 THEN '{{"contacts":[]}}'
     ELSE {_contact("p_partkey", "p_partkey % 51")} END AS asset_contacts,
CASE WHEN p_partkey % 3 = 0 THEN NULL
     ELSE {_tags("p_partkey", 25, 7, extra=',"USER_DEFINED_RESOURCE~999"')} END AS asset_governed_tags,
CASE WHEN p_partkey % 8 = 0 THEN '{{"metadata":{{"owner":"o' || CAST(p_partkey % 9 AS STRING) || '"}}}}' ELSE NULL END AS custom_metadata,
{_audit("p_partkey", "_created_at", "last_modified_at", "last_ingested_at")}
"""

_DASHBOARDS = f"""
'DASHBOARD~' || CAST(s_suppkey AS STRING) AS id, 'DASHBOARD' AS entity_type,
'{{"platform":"' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'P' || CAST(s_nationkey AS STRING) END || '"}}' AS logical_id,
'{{"title":"' || s_name || '"' || CASE WHEN s_suppkey % 3 = 0 THEN ''
     ELSE ',"description":"dash","powerBi":{{"powerBiDashboardType":"REPORT"}}' END || '}}' AS dashboard_info,
'{{"name":"s' || CAST(s_suppkey AS STRING) || '","directories":["d1","d2"]}}' AS structure,
{_followers("s_suppkey", 34)} AS asset_followers,
{_contact("s_suppkey", "s_suppkey")} AS asset_contacts,
CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE {_tags("s_suppkey", 25)} END AS asset_governed_tags,
'{{"mainUrl":"https://example.com/d/' || CAST(s_suppkey AS STRING) || '"}}' AS source_info,
CASE WHEN s_suppkey % 5 = 0 THEN NULL
     ELSE '{{"sourceDatasets":["DATASET~' || CAST(s_suppkey % 13 AS STRING) || '"]}}' END AS entity_upstream,
{_audit("s_suppkey", "_created_at", "last_modified_at", "last_ingested_at")}
"""

_VIRTUAL_VIEWS = f"""
'VIRTUAL_VIEW~' || CAST(doc_id AS STRING) AS id, 'VIRTUAL_VIEW' AS entity_type,
'{{"name":"vv' || CAST(doc_id AS STRING) || '","platform":"' || lang || '"}}' AS logical_id,
'{{"name":"v' || CAST(doc_id AS STRING) || '","directories":["' || source || '"]}}' AS structure,
CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {_followers("doc_id", 34)} END AS asset_followers,
{_contact("doc_id", "doc_id % 51")} AS asset_contacts,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_tags("doc_id", 25, 7)} END AS asset_governed_tags,
{_audit("doc_id", "_created_at", "last_modified_at", "last_ingested_at")}
"""

_CARDS = f"""
'KNOWLEDGE_CARD~' || CAST(o_orderkey AS STRING) AS id, CAST(o_orderdate AS TIMESTAMP) AS _created_at,
CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS TIMESTAMP) ELSE NULL END AS deleted_at,
CASE WHEN o_orderkey % 3 = 0
     THEN '{{"anchorEntityId":"DATASET~' || CAST(o_orderkey % 200 AS STRING) || '","created":{{"actor":"PERSON~'
          || CAST(o_custkey AS STRING) || '"}},"detail":{{"type":"ASSET_DESCRIPTION","assetDescription":{{"description":"card '
          || CAST(o_orderkey AS STRING) || '"}}}}}}'
     ELSE '{{"anchorEntityId":"DATASET~' || CAST(o_orderkey % 200 AS STRING) || '","created":{{"actor":"PERSON~'
          || CAST(o_custkey AS STRING) || '"}},"detail":{{"type":"QUERY_DESCRIPTION","query":{{"title":"q'
          || CAST(o_orderkey AS STRING) || '","isMarkedAsCurated":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END
          || ',"explanations":[{{"explanation":"why"}}],"query":"SELECT 1"}}}}}}' END AS knowledge_card_info,
{_audit("o_orderkey", "last_modified_at")},
CASE WHEN o_orderkey % 6 = 5 THEN {_followers("o_orderkey", 89)} ELSE NULL END AS asset_followers,
CASE WHEN o_orderkey % 4 = 1 THEN {_contact_as_string("o_orderkey", "o_orderkey % 51")} ELSE NULL END AS asset_contacts,
CASE WHEN o_orderkey % 3 = 2 THEN {_tags("o_orderkey", 23, 9)} ELSE NULL END AS asset_governed_tags
"""

# Cards about namespaces; one type in three is not the description type.
_NAMESPACE_CARDS = """
'KNOWLEDGE_CARD~N' || CAST(s_suppkey AS STRING) AS id, TIMESTAMP '2024-02-01 00:00:00' AS _created_at,
CAST(NULL AS TIMESTAMP) AS deleted_at,
'{"anchorEntityId":"NAMESPACE~' || CAST(s_suppkey % 37 AS STRING) || '","created":{"actor":"PERSON~'
     || CAST(s_nationkey AS STRING) || '"},"detail":{"type":"'
     || CASE WHEN s_suppkey % 3 = 0 THEN 'HOW_TO_USE' ELSE 'ASSET_DESCRIPTION' END
     || '","assetDescription":{"description":'
     || CASE WHEN s_suppkey % 7 = 0 THEN 'null' ELSE '"ns card ' || CAST(s_suppkey AS STRING) || '"' END || '}}}' AS knowledge_card_info,
TIMESTAMP '2024-02-02 00:00:00' AS last_modified_at,
CAST(NULL AS STRING) AS asset_followers, CAST(NULL AS STRING) AS asset_contacts,
CAST(NULL AS STRING) AS asset_governed_tags
"""

_NAMESPACES = f"""
'NAMESPACE~' || CAST(s_suppkey AS STRING) AS id,
CASE WHEN s_suppkey % 19 = 18 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE NULL END AS deleted_at,
'{{"name":"ns ' || CAST(s_suppkey AS STRING) || '","detail":{{"type":"'
     || CASE WHEN s_suppkey % 3 = 2 THEN 'DATA_UNIT' WHEN s_suppkey % 11 = 10 THEN 'USER_DEFINED_SPACE' ELSE 'DATA_GROUP' END || '"}},'
     || CASE WHEN s_suppkey < 5 THEN '' ELSE '"parentId":"NAMESPACE~' || CAST(CAST(FLOOR(s_suppkey / 4.0) AS BIGINT) AS STRING) || '",' END
     || '"created":{{"actor":"PERSON~' || CAST(s_nationkey * 17 AS STRING) || '","time":"2024-01-01T00:00:00Z"}}'
     || CASE WHEN s_suppkey % 2 = 0 THEN ',"description":{{"text":"d' || CAST(s_suppkey AS STRING) || '"}}' ELSE '' END || '}}' AS namespace_info,
CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE {_followers("s_suppkey", 34, 13)} END AS asset_followers,
CASE WHEN s_suppkey % 5 = 0 THEN '{{"contacts":[]}}' ELSE {_contact("s_suppkey", "s_suppkey % 51")} END AS asset_contacts,
CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {_tags("s_suppkey", 25, 8)} END AS asset_governed_tags,
{_audit("s_suppkey", "_created_at", "last_modified_at")}
"""

_DOMAIN_ASSETS = """
'NAMESPACE~' || CAST(s_suppkey AS STRING) AS _id,
CASE WHEN s_suppkey < 5 THEN NULL ELSE 'NAMESPACE~' || CAST(CAST(FLOOR(s_suppkey / 4.0) AS BIGINT) AS STRING) END AS parent,
CASE WHEN s_suppkey % 10 = 9 THEN NULL
     ELSE 'DATASET~' || CAST(s_suppkey AS STRING) || ',DATASET~' || CAST(s_suppkey % 7 AS STRING) END AS live_csv,
'DASHBOARD~' || CAST(s_suppkey AS STRING) || ',UNKNOWN~' || CAST(s_suppkey AS STRING)
     || CASE WHEN s_suppkey % 6 = 0 THEN ',VIRTUAL_VIEW~' || CAST(s_suppkey AS STRING) ELSE '' END AS selected_csv
"""

_EVENTS = """
event_id, ts,
CASE event_type WHEN 'click' THEN 'Search search attempted' WHEN 'view' THEN 'Search semantic search attempted'
     WHEN 'purchase' THEN 'Engagement saved_search created' ELSE 'General sign_in attempted' END AS event_type,
CASE WHEN user_id % 23 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) || '@example.com' END AS email,
CASE WHEN event_type = 'click' THEN 'q' || CAST(event_id % 37 AS STRING) ELSE NULL END AS query,
CASE WHEN event_type = 'click' THEN '[' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'f' || CAST(event_id % 5 AS STRING) END || ']' ELSE NULL END AS selectedfacets,
CASE WHEN event_id % 3 = 0 THEN 'google' WHEN event_id % 3 = 1 THEN 'okta' ELSE NULL END AS identity_provider,
CASE WHEN event_type = 'purchase' THEN 'search ' || CAST(event_id AS STRING) ELSE NULL END AS name,
CASE WHEN event_type = 'purchase' AND event_id % 6 <> 0 THEN 'has:tag' || CAST(event_id % 8 AS STRING) ELSE NULL END AS keyword,
CASE WHEN event_type = 'purchase' THEN 'Datasets' ELSE NULL END AS context,
CASE WHEN event_type = 'purchase' THEN '{}' ELSE NULL END AS facetsjson,
CASE WHEN event_type = 'view' THEN 'answer ' || CAST(event_id % 50 AS STRING) ELSE NULL END AS qaresponse,
CASE WHEN event_type = 'view' THEN '["https://example.com/' || CAST(event_id % 20 AS STRING) || '"]' ELSE NULL END AS searchresults
"""

# Chains of 20 nodes, each with a way around two of them and a cycle.
_CHAIN = """
'N~' || CAST(p_partkey AS STRING) AS _id,
CASE WHEN p_partkey % 20 <> 0 THEN 'N~' || CAST(p_partkey - 1 AS STRING) END AS parent
"""
_SHORT_CUTS = """
'N~' || CAST(p_partkey AS STRING) AS _id,
CASE p_partkey % 20 WHEN 7 THEN 'N~' || CAST(p_partkey - 3 AS STRING)
     WHEN 2 THEN 'N~' || CAST(p_partkey + 9 AS STRING) END AS parent
"""

# Documents on which readers of JSON may disagree, by the remainder of the key.
EDGE_DOCUMENTS = (
    """'{"a":"x","b":{"c":' || n || '},"list":[1,"z",{"k":2}]}'""",
    """'{"a":"first","a":"last' || n || '","b":{"c":1,"c":2}}'""",
    """'{"a":"x' || n || '"} tail'""",
    """'{"a":"x","b":{"c":' || n""",
    """'{"a":"x' || n || '","list":["z"'""",
    """'{"a":"q' || chr(92) || '"' || chr(92) || 'u0041' || chr(92) || 'n' || n || '","list":[]}'""",
    """'[{"a":"x' || n || '"}]'""",
    """'{"a":null,"b":null,"list":null}'""",
    """'{"a":{"k": [1, ' || n || ']},"b":"text","list":"none"}'""",
    """'{' || chr(39) || 'a' || chr(39) || ':' || chr(39) || 'x' || n || chr(39) || '}'""",
    """'{"a":1.50,"b":{"c":true},"list":[null,1e3]}'""",
    """'{"a":NaN,"list":["z"]}'""",
    """''""",
    """NULL""",
    """'  {"b" : {"c" : "y' || n || '"}}  '""",
)

_EDGES = (
    "p_partkey AS id, CASE p_partkey % "
    + str(len(EDGE_DOCUMENTS))
    + " ".join(f" WHEN {i} THEN {doc}" for i, doc in enumerate(EDGE_DOCUMENTS)).replace(
        "|| n", "|| CAST(p_partkey AS STRING)"
    )
    + " END AS doc"
)


def _profile_events() -> str:
    """Events of every type of the dictionary, each property filled in most events of its types."""
    table = event_properties_by_type()
    kinds = " ".join(
        f"WHEN {i} THEN " + (f"'{name}'" if "[" not in name else f"'{name.partition('[')[0]}' || CAST(event_id % 5 AS STRING)")
        for i, name in enumerate(table)
    )
    holders: dict[str, list[str]] = {}
    for i, names in enumerate(table.values()):
        for name in names:
            holders.setdefault(name.lower(), []).append(str(i))
    columns = [
        f"CASE WHEN event_id % {len(table)} IN ({', '.join(where)}) AND event_id % 4 <> 0 "
        f"THEN '{name} ' || CAST(event_id % 17 AS STRING) END AS {name}"
        for name, where in holders.items()
    ]
    return f"event_id, CASE event_id % {len(table)} {kinds} END AS event_type, {', '.join(columns)}"


# Derived table: the test tables it is read from, each with its select list.
RECIPES: dict[str, tuple[tuple[str, str], ...]] = {
    "users": (("customer", _USERS),),
    "user_defined_resource": (("nation", _RESOURCES),),
    "datasets": (("part", _DATASETS),),
    "dashboards": (("supplier", _DASHBOARDS),),
    "virtual_views": (("documents", _VIRTUAL_VIEWS),),
    "knowledge_cards": (("orders", _CARDS), ("supplier", _NAMESPACE_CARDS)),
    "namespaces": (("supplier", _NAMESPACES),),
    "domain_assets": (("supplier", _DOMAIN_ASSETS),),
    "usage_events": (("events", _EVENTS),),
    "profile_events": (("events", _profile_events()),),
    "edge_documents": (("part", _EDGES),),
    "hierarchy": (("part", _CHAIN), ("part", _SHORT_CUTS)),
}


# Schemas of the test tables that are read, so that reading needs no inference.
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "documents": "doc_id bigint, lang string, source string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}

# Test tables from which most documents are made.
SPREAD = ("part", "orders")


def recipe_sql(table: str) -> str:
    """The recipe as one query over the test tables."""
    return " UNION ALL ".join(f"SELECT {select} FROM {source}" for source, select in RECIPES[table])


def _read(spark: SparkSession, sf_dir: str, source: str) -> str:
    """Name of a view of a test table.

    A test table is one small file, so one task reads it. The rows of those with most documents are
    dealt out first: making and parsing them is then parallel, as on the many files of a real table.
    """
    view = f"source_{source}"
    rows = spark.read.schema(SOURCE_SCHEMAS[source]).parquet(f"{sf_dir}/{source}.parquet")
    if source in SPREAD:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])
    rows.createOrReplaceTempView(view)
    return view


def derived_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    parts = [
        spark.sql(f"SELECT {select} FROM {_read(spark, sf_dir, source)}")
        for source, select in RECIPES[table]
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    if table == "domain_assets":
        df = df.select(
            "_id",
            "parent",
            F.split("live_csv", ",").alias("live_query_assets"),
            F.split("selected_csv", ",").alias("selected_assets"),
        )
    return df


def derived_catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The named catalog tables, all of them by default."""
    wanted = names or table_names()
    return Catalog.from_frames(**{name: derived_table(spark, sf_dir, name) for name in wanted})


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_table(spark, sf_dir, "usage_events")
