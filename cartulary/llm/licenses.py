"""Licence scans by a trained paragraph classifier.

Sparse multinomial logistic regression over word n-grams names the licence family of a paragraph,
or none. Its training rows are notices of each family, whole and with words left out, and
paragraphs of a bounded sample of documents, labelled by the templates. A temperature fitted on
rows held out calibrates the probabilities; below an even chance the family is unknown. A predicted
family is confirmed where the paragraph holds enough of one of its templates.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Customary notices by licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the GNU Affero General Public License",
        "released under the terms of the GNU AGPL",
    ),
    "apache": (
        "licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "released under the Apache License 2.0",
    ),
    "bsd": (
        "licensed under the BSD License",
        "released under the BSD 3-Clause License",
        "redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "cc": (
        "licensed under a Creative Commons Attribution License",
        "this work is licensed under CC BY 4.0",
        "licensed under CC BY-NC 4.0",
        "licensed under CC BY-SA 4.0",
        "available under the Creative Commons Attribution-ShareAlike License",
    ),
    "gpl": (
        "licensed under the GNU General Public License, version 3",
        "released under the terms of the GNU GPL",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "released under the terms of the GNU LGPL",
    ),
    "mit": (
        "released under the MIT License",
        "licensed under the MIT License",
        "permission is hereby granted, free of charge, to any person obtaining a copy",
    ),
    "mpl": (
        "subject to the terms of the Mozilla Public License",
        "licensed under the Mozilla Public License, Version 2.0",
    ),
    "proprietary": (
        "all rights reserved",
        "unauthorized copying or distribution of this file is strictly prohibited",
    ),
    "public_domain": (
        "dedicated to the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
}
UNKNOWN = "unknown"

#: Documents whose paragraphs stand for texts without a licence, those with the least hash.
SAMPLE = 2_000
#: Most paragraphs of one sampled document.
SAMPLE_PARAGRAPHS = 20
#: Share of a template's word pairs that confirms a prediction.
CONFIRMED = 0.6


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours, in order."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return list(dict.fromkeys([*words, *pairs]))


@lru_cache(maxsize=1)
def _template_pairs() -> list[tuple[str, set[tuple[str, str]]]]:
    split = [(f, tokens(t)) for f, ts in TEMPLATES.items() for t in ts]
    return [(f, set(zip(t, t[1:], strict=False))) for f, t in split]


def template_label(words: list[str]) -> str:
    """The family of the template that the words hold the largest share of, if it is enough."""
    own = set(zip(words, words[1:], strict=False))
    share, family = max((len(pairs & own) / len(pairs), f) for f, pairs in _template_pairs())
    return family if share >= CONFIRMED else UNKNOWN


def notices() -> list[tuple[list[str], str]]:
    """Each template whole, with a lead-in, and with each one of its words left out."""
    out = []
    for family, templates in TEMPLATES.items():
        for text in templates:
            words = tokens(text)
            out += [(words, family), (["this", "work", "is", *words], family)]
            out += [(["copyright", "c", "2024", *words], family)]
            out += [(words[:i] + words[i + 1 :], family) for i in range(len(words)) if len(words) > 4]
    return out


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    #: How many background paragraphs hold each word of the features.
    seen: dict[str, int]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[list[str], str]], penalty: float = 2e-4, rounds: int = 400) -> Model:
    """Proximal gradient steps with an absolute-value penalty, so most weights are zero.

    Features are n-grams of the templates; rows with the same features and class are one row with
    a weight. Every fourth of these is held out for the temperature.
    """
    classes = (*sorted(TEMPLATES), UNKNOWN)
    names = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
    place = {g: i for i, g in enumerate(names)}
    alike = Counter((tuple(sorted(place[g] for g in grams(w) if g in place)), c) for w, c in rows)
    x = np.zeros((len(alike), len(names)))
    for i, (features, _) in enumerate(alike):
        x[i, list(features)] = 1
    y = np.array([classes.index(label) for _, label in alike])
    times = np.array(list(alike.values()), float)
    held = np.arange(len(alike)) % 4 == 3
    share = np.bincount(y[~held], times[~held], len(classes))
    cost = times / np.maximum(share, 1)[y] * (~held)
    cost /= cost.sum()
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[y]
    for _ in range(rounds):
        slope = (_softmax(x @ w + b) - target) * cost[:, None]
        w -= 2.0 * (x.T @ slope)
        b -= 2.0 * slope.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * penalty, 0)
    z = x[held] @ w + b
    grid = np.geomspace(0.1, 10, 60)

    def loss(t: float) -> float:
        own = np.log(_softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12)
        return -float((own * (times / np.maximum(share, 1)[y])[held]).sum())

    used = np.abs(w).sum(1) > 0
    return Model(
        classes,
        {g: tuple(w[i].round(9).tolist()) for g, i in place.items() if used[i]},
        tuple(b.round(9).tolist()),
        float(min(grid, key=loss)) if held.any() else 1.0,
        dict(Counter(x for w, c in rows if c == UNKNOWN for x in set(w) if x in place)),
    )


def paragraphs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the texts of the lines of each document, numbered from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("paragraph", "line"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier, from the notices and the lines of at most ``sample`` documents.

    The driver gets at most ``sample * SAMPLE_PARAGRAPHS`` lines of at most 400 characters;
    this bounds the training rows alone, scans read all.
    """
    few = docs.orderBy(F.xxhash64("doc_id", "text")).limit(sample)
    lines = F.slice(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1),
                    1, SAMPLE_PARAGRAPHS)
    rows = few.select(F.explode(lines).alias("line")).select(F.substring("line", 1, 400).alias("line"))
    background = [tokens(r["line"]) for r in rows.collect()]
    background.sort()
    return fit(notices() + [(w, template_label(w)) for w in background if w])


def _array(values: tuple[float, ...] | list[float]) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def anchors(model: Model) -> list[str]:
    """Words without which no paragraph has a family.

    To leave the unknown class, a paragraph's features must lift another class by the lead of the
    unknown class's bias. Common words are set aside, the most frequent first, as long as all
    features made of such words together lift less than that; any paragraph with a family then
    holds one of the other words.
    """
    unknown = model.classes.index(UNKNOWN)
    lead = model.bias[unknown] - np.array(model.bias)
    lead[unknown] = np.inf
    lifts = {
        frozenset(g.split()): np.maximum(np.array(w) - w[unknown], 0)
        for g, w in model.weights.items()
    }
    words = sorted({x for g in lifts for x in g}, key=lambda x: (-model.seen.get(x, 0), x))
    aside: set[str] = set()
    for word in words:
        wider = aside | {word}
        if (sum(v for g, v in lifts.items() if g <= wider) < lead).all():
            aside = wider
    return [x for x in words if x not in aside]


def scan_licenses(docs: DataFrame, model: Model, confirmed: float = CONFIRMED) -> DataFrame:
    """One row per licence paragraph: ``doc_id, paragraph, family, probability, similarity,
    confirmed``.

    Whole texts are read line by line. Paragraphs of the unknown class give no row. Null and
    empty texts have none; repeated rows give repeated results; a null ``doc_id`` stays null.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = paragraphs(kept.where(_may_hold("text", model)), ["doc_id"])
    return _classified(lines.where(_may_hold("line", model)), model, confirmed)


def _may_hold(column: str, model: Model) -> Column:
    """A cheap test that every text with a licence paragraph passes."""
    words = f"split(lower(CAST({column} AS STRING)), '[^a-z0-9]+')"
    return F.expr(f"arrays_overlap({words}, array({', '.join(map(_text, anchors(model)))}))")


def _classified(lines: DataFrame, model: Model, confirmed: float) -> DataFrame:
    words = lines.withColumn(
        "words", F.expr("filter(split(lower(line), '[^a-z0-9]+'), x -> x <> '')")
    )
    pairs = words.withColumn(
        "pairs",
        F.expr(
            "CASE WHEN size(words) > 1 THEN transform(sequence(0, size(words) - 2),"
            " i -> concat(words[i], ' ', words[i + 1])) ELSE CAST(array() AS ARRAY<STRING>) END"
        ),
    )
    names = sorted(model.weights)
    known = f"array({', '.join(map(_text, names))})" if names else "CAST(array() AS ARRAY<STRING>)"
    hits = pairs.withColumn("hits", F.expr(f"array_intersect(concat(words, pairs), {known})"))
    entries = ", ".join(f"{_text(g)}, {_array(model.weights[g])}" for g in names)
    table = f"map({entries})" if names else "CAST(map() AS MAP<STRING, ARRAY<DOUBLE>>)"
    # Generators keep the optimizer from copying long expressions into the filters after them.
    hits = hits.select("doc_id", "paragraph", "pairs", F.explode(F.array("hits")).alias("hits"))
    scores = (
        f"transform(aggregate(hits, {_array(model.bias)}, (a, g) -> zip_with(a,"
        f" element_at({table}, g), (x, y) -> x + y)), x -> x / {model.temperature!r}D)"
    )
    scored = hits.select("doc_id", "paragraph", "pairs", F.expr(f"explode(array({scores})) AS scores"))
    best = scored.select("*", F.expr("explode(array(array_max(scores))) AS top"))
    classes = f"array({', '.join(map(_text, model.classes))})"
    named = best.withColumn(
        "family", F.expr(f"element_at({classes}, CAST(array_position(scores, top) AS INT))")
    ).withColumn("probability", F.expr("1 / aggregate(scores, 0D, (a, x) -> a + exp(x - top))"))
    found = named.where(f"family <> '{UNKNOWN}' AND probability >= 0.5")
    cases = []
    for family, templates in TEMPLATES.items():
        shares = []
        for text in templates:
            t = tokens(text)
            own = sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)})
            shares.append(f"size(array_intersect(pairs, array({', '.join(map(_text, own))}))) / {len(own)}")
        cases.append(f"WHEN family = '{family}' THEN array_max(array({', '.join(shares)}))")
    similar = found.withColumn("similarity", F.expr(f"CASE {' '.join(cases)} END"))
    return similar.select(
        "doc_id",
        "paragraph",
        "family",
        "probability",
        "similarity",
        (F.col("similarity") >= confirmed).alias("confirmed"),
    )
