"""Near duplicates, decontamination and chat trees against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cartulary.llm import chat, decontam, jaccard
from cartulary.llm.components import components
from tests.llm.conftest import SCHEMA, hostile_texts, prose

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc_id), doc_id)
    return sorted((d or -1, len(s), lowest.get(root(i), -1) if s else (d if d is not None else -1))
                  for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got_components(frame, k, percent):
    none = lambda x: -1 if x is None else x
    return sorted((r.doc_id or -1, r.n_shingles, none(r.component_id))
                  for r in jaccard.link_documents(frame, k, percent).collect())


def test_hostile_documents(hostile, nothing):
    assert got_components(hostile, 4, 85) == brute_components(hostile_texts(), 4, 85)
    assert jaccard.link_documents(nothing).collect() == []


@pytest.mark.parametrize("block", [1 << 22, 400])
def test_chains_of_edits(spark, monkeypatch, block):
    """Edits near the limit, chains whose ends are apart, and shared passages, in small blocks too."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    rows = []
    passage = prose(70, 60)
    for g in range(12):
        words = prose(100 + g, r.randint(4, 160)).split()
        for _ in range(r.randint(1, 9)):
            words = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 60)):
                words[r.randrange(len(words))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(words) + (f" {passage}" if g % 3 == 0 else "")))
    frame = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in rows], SCHEMA)
    for k, percent in ((4, 85), (5, 80)):
        assert got_components(frame, k, percent) == brute_components(rows, k, percent)


def test_divide_skip_finds_all_members_of_enough_lists():
    r = random.Random(2)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(1, 25))) for _ in range(r.randint(1, 12))]
        least = r.randint(1, len(lists))
        want = {x for x in range(30) if sum(x in y for y in lists) >= least}
        found = {x: n + sum(x in y for y in long) for x, n, long in jaccard.divide_skip(lists, least)}
        assert {x for x, n in found.items() if n >= least} == want


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5), (1000, -4)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    apart = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in apart}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert decontam.common_subsequence(decontam.word_bits(a), len(a), b) == lcs(a, b)


def test_copies_and_paraphrases_are_found(spark, hostile, nothing):
    items = [(i, prose(500 + i, 20 + 3 * i)) for i in range(8)]
    benchmark = spark.createDataFrame(
        [*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string"
    )
    rows, want = [], set()
    for i in range(60):
        words = prose(900 + i, 200).split()
        if i % 3 == 0:
            item, text = items[i % 8]
            inside = text.split()
            for k in range(0, len(inside), 11):
                inside[k] = "changed"
            at = (i * 7) % 150
            words[at:at] = inside
            want.add((i, item))
        rows.append((i, " ".join(words), "en", "s", 0, 1, "x", 2))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = decontam.find_contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.copied or r.shared >= decontam.SHARED for r in found)
    assert decontam.find_contaminated(hostile, benchmark).collect() == []
    assert decontam.find_contaminated(nothing, benchmark).collect() == []
    assert decontam.find_contaminated(docs, benchmark.limit(0)).collect() == []


LENGTHS = (1, 3, 6, 8, 12, 13, 20, 40, 130, 300, 1000)


def planted(make, lengths, copies=12):
    """Documents with a changed item of each length at a random place, and the pairs planted."""
    items = [(n, " ".join(f"{w}{'xq' if n < 8 else ''}" for w in prose(7000 + n, n).split())) for n in lengths]
    rows, want, r = [], set(), random.Random(31)
    for k in range(copies):
        for n, text in items:
            doc, words = 10_000 * k + n, prose(20_000 + 1000 * k + n, 150).split()
            inside = make(text.split(), r)
            at = r.randrange(len(words))
            words[at:at] = inside
            rows.append((doc, " ".join(words), "en", "s", 0, 1, "x", 2))
            want.add((doc, n, tuple(inside)))
    return items, rows, want


def found_pairs(spark, items, rows):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {(r.doc_id, r.item_id): r for r in decontam.find_contaminated(docs, benchmark).collect()}


def test_verbatim_items_of_any_length_are_found(spark):
    items, rows, want = planted(lambda words, r: words, LENGTHS)
    found = found_pairs(spark, items, rows)
    assert set(found) == {x[:2] for x in want}
    assert all(x.copied == n for (_, n), x in found.items())


def test_copied_parts_are_found(spark):
    def part(words, r):
        at = r.randrange(len(words) - 13)
        return words[at : at + r.randint(13, max(13, len(words) // 3))]

    items, rows, want = planted(part, (20, 40, 130, 300, 1000))
    found = found_pairs(spark, items, rows)
    assert set(found) == {x[:2] for x in want}


def test_paraphrases_against_all_places(spark):
    """One word in five is another one; what the whole search by subsequences finds is wanted."""

    def changed(words, r):
        return [w if k % 5 != 3 else f"other{r.randrange(10**6)}" for k, w in enumerate(words)]

    items, rows, want = planted(changed, (8, 10, 12, 16, 20, 30, 40, 90), copies=25)
    found = found_pairs(spark, items, rows)
    by_length = defaultdict(list)
    for doc, n, inside in want:
        numbers = {w: i for i, w in enumerate(sorted(set(dict(items)[n].split())))}
        item = decontam.Item(n, np.array([numbers[w] for w in dict(items)[n].split()]))
        if item.confirm([numbers.get(w, -1) for w in inside]):
            by_length[n].append((doc, n) in found)
    recall = {n: sum(x) / len(x) for n, x in sorted(by_length.items())}
    assert len(recall) == 8 and min(recall.values()) >= 0.9, recall
    assert set(found) <= {x[:2] for x in want}


def test_the_filter_by_rare_words_loses_no_match():
    r = random.Random(12)
    sequence = np.array(r.sample(range(60), 40))
    frequency = np.array([r.randrange(1, 50) for _ in range(60)], float)
    (scale,) = decontam._scales([sequence], frequency)
    item = decontam.Item(0, sequence)
    for _ in range(300):
        text = [r.randrange(60) for _ in range(200)]
        kept = [x for x in sequence.tolist() if r.random() < 0.85]
        at = r.randrange(150)
        text[at:at] = kept
        numbers = np.array(text)
        starts = set(scale.starts(numbers, np.arange(len(text)) // decontam.UNIT, -(-len(text) // decontam.UNIT)))
        for a in range(0, -(-len(text) // decontam.UNIT), decontam.WINDOWS[scale.length]):
            low = max(a * decontam.UNIT - item.n // 2, 0)
            if item.confirm(text[low : (a + scale.length) * decontam.UNIT + item.n // 2]):
                assert a in starts


def test_latent_space_is_that_of_a_dense_decomposition(spark):
    """Cosines in the randomised space agree with an exact singular value decomposition."""
    items = decontam.read_items([(i, prose(i, 40)) for i in range(6)])
    size = len(items.vocabulary)
    docs = spark.createDataFrame(
        [(i, prose(i % 9, 32 * (1 + i % 3)), "en", "s", 0, 1, "x", 2) for i in range(90)], SCHEMA
    )
    numbered = decontam._numbered(docs, items.vocabulary)
    space, frequency = decontam.latent_space(numbered, np.uint16, size, 4, 40, 7)
    rows = []
    for r in numbered.collect():
        numbers = np.frombuffer(r.words, np.uint16).astype(int) - 1
        for at in range(0, len(numbers), decontam.PASSAGE):
            part = numbers[at : at + decontam.PASSAGE]
            rows.append(np.bincount(part[part >= 0], minlength=size))
    counts = np.array(rows, float)
    assert (frequency == (counts > 0).sum(0)).all()
    weight = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0)))
    _, sigma, v = np.linalg.svd(counts * weight, full_matrices=False)
    exact = weight[:, None] * v[:4].T / sigma[:4]
    assert np.allclose(counts @ space @ (counts @ space).T, counts @ exact @ (counts @ exact).T, atol=1e-3)


def test_trees_give_their_best_branches(spark):
    rows = [
        ("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 5.0, "assistant", "b"),
        ("t", 4, 2, 9.0, "user", "c"), ("t", 5, 3, 1.0, "user", None), ("t", 6, 3, None, None, "d"),
        ("loop", 1, 2, 0.0, "user", "x"), ("loop", 2, 1, 0.0, "user", "y"), ("orphan", 7, 99, 0.0, "user", "z"),
    ]
    messages = spark.createDataFrame(
        rows, "tree string, node long, parent long, score double, role string, text string"
    )
    got = defaultdict(list)
    for r in chat.chosen_paths(messages, branches=2).collect():
        got[r.tree, r.branch_rank].append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {
        ("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("orphan", 1): [7],
    }
    turns = sorted((r.tree, r.depth, r.formatted, r.trained) for r in chat.format_paths(messages).collect())
    assert turns[1:] == [("t", 1, "### user: q</turn>\n", False), ("t", 2, "### assistant: a</turn>\n", True),
                         ("t", 3, "### user: c</turn>\n", False)]


def test_conversations_read_back(spark):
    r = random.Random(4)
    parts = ["\\", "#", "### Assistant: ", "</turn>", "\n", "<", ": ", "é", "a", "\\\\", "😀", "$1"]
    rows = []
    for conv in [*range(20), None]:
        for turn in range(r.randint(1, 17)):
            text = "".join(r.choices(parts, k=r.randint(0, 9)))
            rows.append((conv, turn, r.choice(["user", "assistant", "a: b<", None]), r.choice([text, text, None])))
    rows += [rows[0]] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.tree: x for x in chat.read_back(chat.format_paths(chat.chains(frame, "conv_id", "turn"))).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or "", text or ""))
    assert len(got) == len(by_conv)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda x: x[0])
        x = got["" if conv is None else str(conv)]
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (x.n_turns, x.loss_chars) == (len(turns), len(loss))
        assert x.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.formatted_chars == sum(len(chat.format_turn(role, t)) for _, role, t in turns)
    empty = frame.limit(0)
    assert chat.read_back(chat.format_paths(chat.chains(empty, "conv_id", "turn"))).collect() == []


def test_word_hashes_do_not_depend_on_what_is_hashed_together(monkeypatch):
    from cartulary.llm import common

    is_word = common.byte_table(common.SPACES)
    texts = [t or "" for _, t in hostile_texts()] + ["x" * 5000 + " tail", "", "a b"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    whole, first = common.words(data, offsets, is_word)
    monkeypatch.setattr(common, "HASHED", 1000)
    parts, again = common.words(data, offsets, is_word)
    assert (whole == parts).all() and (first == again).all()
    assert first[-1] == len(whole) == sum(len(x.split()) for x in raw)
