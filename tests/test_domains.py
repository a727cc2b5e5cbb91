import json
import random

import pytest
from pyspark.sql import functions as F

from cartulary import (
    Catalog,
    Tuning,
    domain_asset_details,
    domain_asset_names,
    domain_classification,
    domain_creator,
    domain_descendants,
    domain_description,
    domain_queries_long,
    domain_report,
    domain_top_queries,
)


def query_card(asset, title="t", curated=True, kind="QUERY_DESCRIPTION", **query):
    body = {"title": title, "isMarkedAsCurated": curated, **query}
    return {"anchorEntityId": asset, "detail": {"type": kind, "query": body}}


def text_card(anchor, text, kind="ASSET_DESCRIPTION"):
    return {"anchorEntityId": anchor, "detail": {"type": kind, "assetDescription": {"description": text}}}


@pytest.mark.parametrize(
    "info, expected",
    [
        ({"name": "n", "detail": {"type": "DATA_GROUP"}}, ("n", "", "")),
        ({"name": "n", "detail": {"type": "DATA_GROUP"}, "parentId": None}, ("n", "", "")),
        ({"name": "n", "detail": {"type": "DATA_GROUP"}, "parentId": "p"}, ("", "n", "")),
        ({"name": "n", "detail": {"type": "DATA_UNIT"}, "parentId": "p"}, ("", "", "n")),
        ({"name": "n", "detail": {"type": "USER_DEFINED_SPACE"}}, ("", "", "")),
        ({"name": "n"}, ("", "", "")),
        ({"detail": {"type": "DATA_UNIT"}}, ("", "", None)),
    ],
)
def test_classification(build, info, expected):
    (row,) = domain_classification(build.namespaces(("x", info))).collect()
    assert (row.domain_name, row.subdomain_name, row.data_product_name) == expected


def test_asset_details(build):
    assets = build.domain_assets(
        ("x", None, ["a", "a"], ["b", "a"]),
        ("half", None, None, ["a"]),
        ("twice", "x", ["a"], []),
        ("twice", "y", ["a"], []),
        ("null element", None, [None], ["c"]),
    )
    namespaces = build.namespaces(("x", {"name": "X"}))
    got = {tuple(r) for r in domain_asset_details(assets, namespaces).collect()}
    assert got == {
        ("x", "X", None, "a"), ("x", "X", None, "b"),
        ("twice", None, "x", "a"), ("twice", None, "y", "a"),
        ("null element", None, None, None), ("null element", None, None, "c"),
    }


def recursive_details(rows):
    """Brute force: the anchor rows, each repeated for every ancestor, made distinct."""
    nodes = [(i, p, None if a is None or b is None else a + b) for i, p, a, b in rows]
    level, seen = list(nodes), list(nodes)
    while level:
        level = [n for n in nodes for w in level if n[1] == w[0]]
        seen += level
    return {(i, p, a) for i, p, listed in seen for a in listed or []}


@pytest.mark.parametrize("seed", range(3))
def test_flat_listing_equals_the_recursive_one(build, seed):
    pick = random.Random(seed)
    rows = []
    for n in range(25):
        parent = f"n{pick.randrange(n)}" if n and pick.random() < 0.8 else None
        lists = [
            None if pick.random() < 0.1 else [f"a{pick.randrange(6)}" for _ in range(pick.randrange(4))]
            for _ in range(2)
        ]
        rows.append((f"n{n}", parent, *lists))
    got = domain_asset_details(build.domain_assets(*rows), build.namespaces(("n0", {}))).collect()
    assert {(r.id, r.parent, r.asset) for r in got} == recursive_details(rows)
    assert len(got) == len({(r.id, r.parent, r.asset) for r in got})


def brute_descendants(parents):
    found = set()
    for child in parents:
        path, at, depth = {child}, child, 0
        while parents.get(at) in parents and parents[at] not in path:
            at, depth = parents[at], depth + 1
            path.add(at)
            found.add((at, child, depth))
    return found


@pytest.mark.parametrize(
    "parents",
    [
        {"a": None},
        {"a": None, "b": "a", "c": "b", "d": "a", "e": "c"},
        {"a": "b", "b": "a", "c": "a"},
        {"a": "a", "b": "a"},
        {"a": "gone", "b": "a"},
    ],
)
def test_descendants(build, tuning, parents):
    assets = build.domain_assets(*((n, p, [], []) for n, p in parents.items()))
    got = [tuple(r) for r in domain_descendants(assets, tuning).collect()]
    assert sorted(got) == sorted(brute_descendants(parents))


@pytest.fixture
def catalog(build):
    def make(domain_assets, cards=(), namespaces=()):
        dashboards = build.spark.createDataFrame(
            [("D1", '{"title":"dash"}', '{"platform":"P"}'), ("D2", '{"title":"plain"}', '{"platform":""}')],
            "id string, dashboard_info string, logical_id string",
        )
        views = build.spark.createDataFrame([("V1", '{"name":"view"}')], "id string, structure string")
        return Catalog.from_frames(
            domain_assets=build.domain_assets(*domain_assets),
            knowledge_cards=build.cards(("other", {"detail": {"type": "HOW_TO_USE"}}), *cards),
            namespaces=build.namespaces(*(namespaces or [("x", {"name": "X", "detail": {"type": "DATA_GROUP"}})])),
            datasets=build.datasets({"id": "S1"}),
            dashboards=dashboards,
            virtual_views=views,
            users=build.users("u1", emails={"u1": "a@x"}),
            user_defined_resource=build.resources(T1="n1"),
        )

    return make


def test_asset_names(catalog, tuning):
    tables = catalog([("x", None, ["D1", "S1"], ["D2", "V1", "NOPE"]), ("y", None, ["D1"], [])])
    got = {
        r.id: sorted(tuple(a) for a in r.assets)
        for r in domain_asset_names(tables, tuning=tuning).collect()
    }
    assert sorted(got["x"], key=str) == sorted(
        [("D1", "dash", "P"), ("D2", "plain", None), ("NOPE", None, None), ("S1", "S1", None), ("V1", "view", None)],
        key=str,
    )
    assert got["y"] == [("D1", "dash", "P")]


def test_creator_is_a_list(catalog, tuning):
    tables = catalog(
        [("x", None, [], [])],
        namespaces=[("x", {"created": {"actor": "u1"}}), ("y", {"created": {"actor": "nobody"}}), ("z", {})],
    )
    got = {r.id: [tuple(p) for p in r.created_by] for r in domain_creator(tables, tuning=tuning).collect()}
    assert got == {"x": [("name u1", "a@x")], "y": [(None, None)], "z": [(None, None)]}


def test_description_falls_back_to_cards(catalog, tuning):
    tables = catalog(
        [("x", None, [], [])],
        cards=[
            ("c1", text_card("x", "one")), ("c2", text_card("x", "two", "HOW_TO_USE")),
            ("c3", text_card("x", None)), ("c4", text_card("y", "card")), ("c5", text_card("elsewhere", "no")),
        ],
        namespaces=[("x", {}), ("y", {"description": {"text": "own"}}), ("z", {})],
    )
    got = sorted((r.id, r.description) for r in domain_description(tables, tuning).collect() if r.description)
    assert got == [("x", "one"), ("x", "two"), ("y", "own")]
    assert domain_description(tables, tuning).count() == 4


def test_top_queries(catalog, tuning):
    tables = catalog(
        [("x", None, ["D1", "S1"], []), ("y", None, ["D1"], []), ("z", None, ["V1"], []), ("w", None, ["S2"], [])],
        cards=[
            ("c1", query_card("D1", "one", explanations=[{"explanation": "why"}], query="SELECT 1")),
            ("c2", query_card("D1", "two")),
            ("c3", query_card("S1", "three")),
            ("c4", query_card("S1", "not curated", curated=False)),
            ("c5", query_card("S1", "wrong kind", kind="HOW_TO_USE")),
            ("c6", query_card("S1", "deleted"), True),
            ("c7", query_card("S2", None)),
        ],
    )
    got = {}
    for r in domain_top_queries(tables, tuning=tuning).collect():
        got.setdefault(r.id, []).extend(tuple(q) for q in r.top_queries or [])
    one, two, three = ("one", "why", "SELECT 1"), ("two", None, None), ("three", None, None)
    assert {k: sorted(v) for k, v in got.items()} == {
        "x": [one, three, two], "y": [one, two], "z": [], "w": [],
    }
    rows = {r.id: r.top_queries for r in domain_top_queries(tables).collect()}
    assert rows["z"] is None and rows["w"] is None and len(rows["x"]) == 3
    assert domain_queries_long(tables, tuning).count() == 5


def test_long_lists_stay_one_row(catalog):
    tables = catalog(
        [("x", None, ["D1"], []), ("y", None, ["S1"], [])],
        cards=[(f"c{i}", query_card("D1", f"q{i}")) for i in range(40)] + [("s", query_card("S1", "s"))],
    )
    for tuning in (Tuning(), Tuning(hot_rows=1), Tuning(broadcast_bytes=-1, hot_rows=5)):
        rows = {r.id: r.top_queries for r in domain_top_queries(tables, tuning=tuning).collect()}
        assert len(rows) == 2 and len(rows["y"]) == 1
        assert sorted(q.title for q in rows["x"]) == sorted(f"q{i}" for i in range(40))
    report = domain_report(tables, top_queries="none")
    assert "top_queries" not in report.columns
    with pytest.raises(ValueError):
        domain_report(tables, top_queries="some")


def test_queries_of_an_asset_are_listed_once(catalog, spark):
    """What meets the namespaces is one list for each asset, not a row for each query."""
    cards = [(f"c{i}", query_card("D1", f"q{i}")) for i in range(40)]
    tables = catalog([(f"x{i}", None, ["D1", "S1"], []) for i in range(30)], cards=cards)
    text = domain_top_queries(tables)._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("Join")]
    assert "flatten(collect_list(queries" in above and "title" not in above
    for tuning in (Tuning(), Tuning(broadcast_bytes=-1, hot_rows=7, hot_pairs=50)):
        rows = domain_top_queries(tables, tuning=tuning).collect()
        assert len(rows) == 30
        assert all(sorted(q.title for q in r.top_queries) == sorted(f"q{i}" for i in range(40)) for r in rows)


def joined(cell):
    """The text of a cell by brute force: its queries as JSON without missing fields, ordered."""
    if cell is None:
        return None
    texts = [{k: v for k, v in q.asDict().items() if v is not None} for q in cell]
    return "|".join(sorted(json.dumps(t, separators=(",", ":")) for t in texts))


LAYOUTS = (Tuning(), Tuning(hot_pairs=3), Tuning(broadcast_bytes=-1, hot_rows=4, hot_pairs=20))


@pytest.fixture
def shared_lists(catalog):
    """Namespaces that share a long list, hold several, hold one twice, or none; a null id, a null asset."""
    cards = [(f"a{i}", query_card("D1", f"q{i}", query="SELECT 1")) for i in range(25)]
    cards += [(f"b{i}", query_card("S1", f"p{i}", explanations=[{"explanation": "why"}])) for i in range(6)]
    cards += [("c", query_card("V1", None, query="x|y")), ("e", query_card("V1", None))]
    cards += [(f"t{i}", text_card("x0", f"text {i}")) for i in range(9)]
    listed = [(f"x{i}", None, ["D1"], ["S1"] if i % 3 else ["V1", "S1"]) for i in range(12)]
    listed += [("twice", "x0", ["D1"], []), ("twice", "x1", ["D1", "V1"], []), ("other", None, ["V1"], [None])]
    listed += [("none", None, ["D2", None], []), (None, None, ["D1"], []), ("half", None, None, ["D1"])]
    unit = {"name": "X", "detail": {"type": "DATA_UNIT"}}
    names = [f"x{i}" for i in range(12)] + ["twice", "other", "none", "half", "gone"]
    return catalog(listed, cards=cards, namespaces=[(n, unit) for n in names])


@pytest.mark.parametrize("layout", LAYOUTS, ids=["plain", "small blocks", "split"])
def test_cells_as_one_text(shared_lists, layout):
    arrays = domain_top_queries(shared_lists, tuning=layout).collect()
    got = domain_top_queries(shared_lists, tuning=layout, queries_joined_by="|").collect()
    assert sorted((str(r.id), r.top_queries) for r in got) == sorted(
        (str(r.id), joined(r.top_queries)) for r in arrays
    )
    cells = {r.id: r.top_queries for r in got}
    assert cells["twice"].count('"q3"') == 2 and cells["none"] is None and cells[None] is None
    assert cells["other"] == '{"query":"x|y"}'


def test_report_with_cells_as_one_text(shared_lists, monkeypatch):
    monkeypatch.setattr("cartulary.plans.domains.CELL_ROWS", 4)
    for layout in LAYOUTS[:2]:
        arrays = domain_report(shared_lists, tuning=layout)
        report = domain_report(shared_lists, tuning=layout, queries_joined_by="|")
        assert report.columns == arrays.columns
        want = [(r.domain_id, r.description, joined(r.top_queries)) for r in arrays.collect()]
        got = [(r.domain_id, r.description, r.top_queries) for r in report.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 25


def test_text_cells_are_not_gathered(shared_lists):
    """The last join makes the cells: nothing above it groups or moves them."""
    for report in (domain_top_queries, domain_report):
        df = report(shared_lists, queries_joined_by="|")
        text = df._jdf.queryExecution().optimizedPlan().toString()
        above = text[: text.index("Join")]
        assert "array_join" in above
        assert not any(word in above for word in ("Aggregate", "Repartition", "Sort "))


def test_a_list_goes_to_a_block_once(catalog):
    """Cells that share their lists share the block that holds them."""
    cards = [(f"c{i}", query_card("D1", f"q{i}")) for i in range(10)]
    tables = catalog([(f"x{i}", None, ["D1", "S1"], []) for i in range(40)], cards=cards)
    df = domain_top_queries(tables, queries_joined_by="|", tuning=Tuning(hot_pairs=100))
    rows = df.select("id", "top_queries", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 40 and len({r.top_queries for r in rows}) == 1
    assert 1 < len({r.task for r in rows})  # 400 queries in 4 blocks
    (one,) = {r.top_queries for r in rows}
    assert one == "|".join(f'{{"title":"q{i}"}}' for i in range(10))


def test_report_with_many_cards_and_queries(catalog, monkeypatch):
    """A namespace with many cards is made by many tasks, each row with all its queries."""
    monkeypatch.setattr("cartulary.plans.domains.CELL_ROWS", 4)
    cards = [(f"c{i}", text_card("x", f"text {i}")) for i in range(60)]
    cards += [(f"q{i}", query_card("D1", f"q{i}")) for i in range(5)]
    unit = {"name": "X", "detail": {"type": "DATA_UNIT"}}
    tables = catalog([("x", None, ["D1"], [])], cards=cards, namespaces=[("x", unit), ("y", unit)])
    rows = domain_report(tables).collect()
    x = [r for r in rows if r.domain_id == "x"]
    assert sorted(r.description for r in x) == sorted(f"text {i}" for i in range(60))
    assert all(sorted(q.title for q in r.top_queries) == [f"q{i}" for i in range(5)] for r in x)
    assert [r.top_queries for r in rows if r.domain_id == "y"] == [None]
    optimized = domain_report(tables)._jdf.queryExecution().optimizedPlan().toString()
    # The cells are joined above the cards, by the piece of the namespace.
    top = next(line for line in optimized.splitlines() if "Join LeftOuter" in line)
    assert "salt" in top


def test_descendants_of_diamonds_are_pairs(build):
    levels = 6
    rows = [(f"{i}{side}", f"{i - 1}{up}", [], []) for i in range(1, levels) for side in "ab" for up in "ab"]
    assets = build.domain_assets(*rows, ("0a", None, [], []), ("0b", None, [], []))
    got = [tuple(r) for r in domain_descendants(assets).collect()]
    want = [(f"{i}{a}", f"{j}{b}", j - i) for i in range(levels) for j in range(i + 1, levels) for a in "ab" for b in "ab"]
    assert sorted(got) == sorted(want)


def test_report_keeps_live_groups_and_units(catalog, spark, tuning):
    tables = catalog(
        [("x", None, ["D1"], [])],
        cards=[("c1", text_card("x", "one")), ("c2", text_card("x", "two"))],
        namespaces=[
            ("x", {"name": "X", "detail": {"type": "DATA_GROUP"}, "created": {"time": "now"}}),
            ("y", {"name": "Y", "detail": {"type": "DATA_UNIT"}}),
            ("z", {"name": "Z", "detail": {"type": "USER_DEFINED_SPACE"}}),
        ],
    )
    rows = domain_report(tables, tuning=tuning).collect()
    assert sorted((r.domain_id, r.domain_name, r.data_product_name, r.description or "") for r in rows) == [
        ("x", "X", "", "one"), ("x", "X", "", "two"), ("y", "", "Y", ""),
    ]
    x = next(r for r in rows if r.domain_id == "x")
    assert (x.created_at, x.followers, x.contacts, x.asset_tags, x.top_queries) == ("now", None, None, None, None)
    assert [tuple(a) for a in x.assets] == [("D1", "dash", "P")]
