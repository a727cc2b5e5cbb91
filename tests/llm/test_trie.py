"""The prefix trie against a plain one in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cartulary.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, place long, id string"


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)} {role}{text}".encode()).hexdigest()


def plain(rows):
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append(((turn is not None, turn or 0, said(role, text)), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(r)] for c, r in original.items()}
    members = defaultdict(set)
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].add(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    out = []
    below = {}
    for prefix in sorted(members, key=len, reverse=True):
        own = (len(members[prefix]) - 1) * (len(WORD.findall(prefix[-1][1])) if prefix else 0)
        under = [below[x] for x in children[prefix]]
        below[prefix] = (sum(x for x, _ in under) or 1, own + sum(x for _, x in under))
        ends = ",".join(map(str, sorted(c for c in members[prefix] if whole[c] == prefix)))
        out.append((
            min(members[prefix]), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(members[prefix]),
            len(children[prefix]), *below[prefix], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed, n, hot=0):
    """Few different turns, so prefixes are shared; one conversation of ``hot`` turns."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, ("user", "assistant")[turn % 2], r.choice(["a b", "a  b\n", "", "über x y", "c"])))
    rows += [(100_000, i, "user", f"t {i % 3}") for i in range(hot)]
    r.shuffle(rows)
    return rows


def hostile():
    rows = conversations(5, 60)
    rows += [
        (None, 0, "user", "lost"), (7_000, None, "user", "first"), (7_000, 0, None, None), (7_000, 0, "", ""),
        (7_001, 1, "user", "x" * 200_000), (7_001, 1, "user", "x" * 200_000), (-40, 0, "user", "a"),
        (-41, 5, "user", "a"), (-41, 6, "user", "b"), (-41, 7, "user", "a"), (-41, 8, "user", "a"),
        (9_000, 0, "ab", "c"), (9_001, 0, "a", "bc"), (9_020, 0, "user", " \t\x0b\x0c\r\n"), (1 << 60, 0, "user", "z"),
    ]
    return rows


def rows_of(spark, rows, few):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    out = trie.prefix_trie(df, few).select(*NAMES).collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("few", [1 << 14, 8])
def test_hostile_conversations(spark, few):
    assert rows_of(spark, hostile(), few) == plain(hostile())


def test_a_long_conversation_and_many_short_ones(spark):
    rows = conversations(6, 150, hot=700)
    assert rows_of(spark, rows, 64) == plain(rows)


def test_no_conversations(spark):
    assert rows_of(spark, [], 8) == []
    assert rows_of(spark, [(None, 0, "user", "x")], 8) == []


def test_all_conversations_alike(spark):
    rows = [(20 * c, t, "user", f"{t} w") for c in range(120) for t in range(3)]
    assert rows_of(spark, rows, 8) == plain(rows)


def test_places_in_ranges(spark):
    spread = spark.range(3000).selectExpr("id % 3 = 0 AS odd", "IF(id % 3 = 0, 1, id) AS g", "id % 7 AS o", "id")
    got = trie.numbered(spread, "g", ["o", "id"], "xxhash64(place)").collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r.g].append((r.o, r.id, r.place, r.f1, r.g1))
    for rows in by_group.values():
        total = 0
        for k, (_, _, place, f, g) in enumerate(sorted(rows), start=1):
            total ^= g
            assert place == k and f == total
