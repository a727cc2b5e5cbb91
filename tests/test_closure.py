"""Reachability by squaring."""

from collections import deque

import pytest

from cartulary import Tuning
from cartulary.operators import closure
from cartulary.operators.closure import descendants


def plain(edges):
    up = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)
    out = set()
    for start in {x for e in edges for x in e}:
        depth, waiting = {start: 0}, deque([start])
        while waiting:
            at = waiting.popleft()
            for parent in up.get(at, ()):
                if parent not in depth:
                    depth[parent] = depth[at] + 1
                    waiting.append(parent)
        out |= {(a, start, d) for a, d in depth.items() if a != start}
    return out


GRAPHS = {
    "tree": [(f"{i}", f"{i // 3}") for i in range(1, 60)],
    "diamond": [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "d"), ("e", "d")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "b"), ("c", "y"), ("y", "y")],
    "star": [(f"leaf {i}", "hub") for i in range(40)] + [("hub", f"top {i}") for i in range(5)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_least_depths(spark, tuning, name):
    parents = spark.createDataFrame(GRAPHS[name], "child string, parent string")
    got = [tuple(r) for r in descendants(parents, tuning).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(GRAPHS[name])


def test_a_long_chain_takes_the_logarithm_of_its_rounds(spark, monkeypatch):
    rounds = []
    join = closure.fan_out_join
    monkeypatch.setattr(closure, "fan_out_join", lambda *a, **k: rounds.append(1) or join(*a, **k))
    chain = [(i, i - 1) for i in range(1, 1000)]
    got = descendants(spark.createDataFrame(chain, "child long, parent long"), Tuning())
    row = got.selectExpr("count(1) AS n", "max(depth) AS d", "sum(descendant - ancestor - depth) AS off").first()
    assert tuple(row) == (1000 * 999 // 2, 999, 0)
    assert len(rounds) <= 11


def test_no_edges(spark):
    assert descendants(spark.createDataFrame([], "child string, parent string")).collect() == []
