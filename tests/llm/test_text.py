"""Secrets, languages, licences and quality against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from cartulary.llm import langid, licenses, quality, secrets
from tests.llm.conftest import SCHEMA, hostile_texts, prose

KEY = "q9Zt4LmXv72PbRw81KdYc05HsJfGnA3e"


def test_base_spans_follow_the_patterns():
    text = (
        "Token = 'abcdefghijkl' secret=short password:password=abcdefghijkl api-key AKIA" + "A1" * 8
        + " deadbeefdeadbeef0 DEADBEEFDEADBEEF ſecret=aaaaaaaaaaaaaaaa"
    )
    found = [(k, text[a:b]) for k, a, b in secrets.ordered(secrets.base_spans(text))]
    assert found == [
        ("assign", "Token = 'abcdefghijkl"),
        ("assign", "password:password=abcdefghijkl"),
        ("access", "AKIA" + "A1" * 8),
        ("hex", "deadbeefdeadbeef0"),
        ("hex", "aaaaaaaaaaaaaaaa"),
    ]


def test_novelty_tells_keys_from_names():
    before = "load the credential from the vault: "
    assert secrets.is_novel(before + KEY, len(before), len(before) + len(KEY))
    for dull in ("configuration_repository_default1", "AAAAAAAA00000000AAAAAAAA00000000"):
        assert not secrets.is_novel(before + dull, len(before), len(before) + len(dull))


@pytest.mark.parametrize("key", [KEY, "QpzTxvWnKjrLmbHgFdscYqRtVwXk", "x7" + "q" * 3 + "Zp0vK2mWc9LtR5hNbD"])
def test_copies_of_a_key_do_not_hide_each_other(key):
    line = f"Authorization: Bearer {key}\n"
    for text in (line, line * 2, line + "a word between\n" * 3 + line * 3):
        got = [text[a:b] for _, a, b in secrets.novel_spans(text, [])]
        assert got == [key] * text.count(key)


def test_letters_alone_may_be_a_key():
    r = random.Random(9)
    found = 0
    for _ in range(100):
        key = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=32))
        found += bool(secrets.novel_spans(f"the bearer token was {key} until today", []))
    assert found >= 97


def test_time_grows_with_the_text():
    from time import perf_counter

    start = perf_counter()
    assert secrets.novel_spans("token " * 400_000, []) == []
    spans = secrets.base_spans("a token=abcdefghijkl " * 20_000)
    assert secrets.novel_spans("a token=abcdefghijkl " * 20_000, spans) == []
    assert perf_counter() - start < 20


def plain_base_spans(text):
    """The patterns tried at every place of a text, one kind after the other."""
    words = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = []
    for kind, pattern, group, shortest in (
        ("assign", re.compile(words, re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and len(m[group]) >= shortest:
                out.append((kind, m.start(), m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


def test_base_spans_of_random_texts():
    r = random.Random(10)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ": ", "'", '"', " ", "abcdef0123456789", "AKIA", "A1B2C3D4",
             "x.y-z/", "deadbeef", "é", "ſ", "password", "\n", "==", "K"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert sorted(secrets.base_spans(text)) == plain_base_spans(text), text


def test_secrets_of_hostile_documents(spark, hostile, nothing):
    assert {r.spans for r in secrets.scan_secrets(hostile).collect()} == {""}
    assert secrets.scan_secrets(nothing).collect() == []
    text = f"the credential {KEY} and é token = '{'ab' * 10}' end"
    (row,) = secrets.scan_secrets(
        spark.createDataFrame([(1, text, "en", "s", 0, 1, "x", 2)], SCHEMA), "[x]", ("doc_id", "n", "source")
    ).collect()
    spans = [x.split(":") for x in row.spans.split(",")]
    assert [x[0] for x in spans] == ["novel", "assign", "hex"] or [x[0] for x in spans] == ["novel", "assign"]
    assert text[int(spans[0][1]) : int(spans[0][2])] == KEY
    assert row.masked.startswith("the credential [x] and é [x]") and row.n == 1
    base = [x for x in spans if x[0] != "novel"]
    digest = hashlib.sha256(",".join(":".join(x) for x in base).encode()).hexdigest()
    assert (row.base_sha256, row.n_assign, row.n_novel) == (digest, 1, 1)


def language_rows():
    r = random.Random(8)
    kinds = {"aa": ["shi", "ka", "no", "mo", "ru"], "bb": ["sch", "ein", "ung", "ge", "ich"]}
    rows = []
    for i in range(120):
        lang = ["aa", "bb"][i % 2]
        words = ["".join(r.choices(kinds[lang], k=3)) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(words), lang, "s", 0, 1, "x", 2))
    return rows


def test_languages_held_out(spark, hostile, nothing):
    rows = language_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs.where("doc_id < 80"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].score > 0.9 for r in rows)
    odd = [r for r in langid.predict(hostile, model).collect() if r.doc_id in (0, 1, 2)]
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    assert langid.predict(hostile, model).count() == len(hostile_texts())
    assert langid.predict(nothing, model).collect() == []
    untrained = langid.train(nothing)
    assert {r.lang_pred for r in langid.predict(docs, untrained).collect()} == {"und"}


def test_code_lengths_are_those_of_the_context_tree(spark):
    docs = spark.createDataFrame(language_rows()[:20], SCHEMA)
    rows = langid.trigram_counts(docs).collect()
    model = langid.train(docs)
    scorer = langid.Scorer(model)
    texts = [b"shikano ungeich", "é😀 ka".encode(), b"k", b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    bits = scorer.lengths(data, offsets)
    for j, lang in enumerate(model.langs):
        counts = {r.code: r.n for r in rows if r.lang == lang}
        for i, text in enumerate(texts):
            assert bits[i, j] == pytest.approx(langid.bits_of(text, counts), rel=1e-4)


def test_licences(spark, hostile, nothing):
    model = licenses.train(hostile)
    notices = {
        "mit": "Released under the MIT License.",
        "apache": "This file is licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
    }
    lines = [prose(9, 30), *notices.values(), "a river of the zone", ""]
    docs = spark.createDataFrame(
        [(1, "\n".join(lines), "en", "s", 0, 1, "x", 2), (1, "\n".join(lines), "en", "s", 0, 1, "x", 2)],
        SCHEMA,
    )
    got = sorted((r.paragraph, r.family, r.confirmed) for r in licenses.scan_licenses(docs, model).collect())
    want = [(i + 1, family, True) for i, family in enumerate(notices)]
    assert got == sorted(want * 2)
    assert licenses.scan_licenses(hostile, model).collect() == []
    assert licenses.scan_licenses(nothing, model).collect() == []
    assert licenses.scan_licenses(docs, licenses.train(nothing)).count() >= 6


def test_gate_loses_no_licence(hostile):
    """Paragraphs without an anchor word keep the unknown class, by the model's own scores."""
    model = licenses.train(hostile)
    known = set(licenses.anchors(model))
    aside = [x for x in {w for g in model.weights for w in g.split()} if x not in known]
    scores = np.array(model.bias)
    for g in licenses.grams(aside):
        scores = scores + np.array(model.weights.get(g, np.zeros(len(scores))))
    for pair in model.weights:
        if " " in pair and set(pair.split()) <= set(aside):
            scores = scores + np.maximum(np.array(model.weights[pair]), 0)
    assert model.classes[int(scores.argmax())] == licenses.UNKNOWN


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text),
            len(lines) - len(set(lines)), len(covered))


def test_statistics_of_texts(spark, hostile, nothing):
    r = random.Random(4)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 40))) for _ in range(40)]
    texts += ["\n".join(r.choices(["a b", "c", " ", ""], k=9)) + "#|<é" for _ in range(20)]
    texts += ["w1 w2 w3 w4 w5 w6 " * 3, "\x0b\x0ca　b\xa0c"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)
    for frame, want in ((docs, texts), (hostile, [t for _, t in hostile_texts()])):
        got = quality.apply_rules(frame, []).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(tuple(x[k] for k in names) for x in got) == sorted(map(statistics, want))
        for x in got:
            failed = x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words
            assert (x.base_failed, x.kept) == (failed, not failed)
    assert quality.apply_rules(nothing, []).collect() == []


def test_rules_are_learned_and_applied_in_order(spark, nothing):
    good = [(i, prose(i, 60), "en", "s", 0, 1, "x", 2) for i in range(200)]
    bad = [(i, prose(i, 60).replace(" ", "## "), "en", "s", 0, 1, "x", 2) for i in range(200, 300)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame(
        [(i, int(i < 200), 0) for i in range(300)] + [(None, 0, 0), (5, None, 0), (999, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    rules = quality.learn(docs, labels)
    assert 1 <= len(rules) <= 3
    kept = {r.doc_id: r.kept for r in quality.apply_rules(docs, rules).collect()}
    assert all(kept[i] == (i < 200) for i in range(300))
    assert quality.learn(docs, labels.limit(0)) == []
    assert quality.learn(nothing, labels) == []
