"""Quality rules: statistics of a text, and an ordered decision list learned from labels.

Rules are conjunctions of thresholds, grown and pruned one after the other by sequential covering:
each covers documents of low quality that the rules before it left, until none is precise enough.
The list becomes one conditional expression; everything is computed inside Spark's expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = r"[\x20\x09-\x0D]"
_LINE_WITH_WORD = r"[^\x20\x09-\x0D]"
#: Words of a window whose repetition counts.
WINDOW = 5

#: Most labelled documents that the list is learned from, those with the least hash of their id.
SAMPLE = 20_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _removed(pattern: str) -> Column:
    """Characters of the text that a class of single characters takes."""
    return F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each whole text; a null text is empty, all counts are 0.

    Words are runs of anything but ASCII white space. ``n_repeat_words`` are words inside a window
    of five that occurs at least twice. Windows are compared by a 64-bit hash of their words.
    """
    own = docs.columns
    named = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    split = named.withColumn("__words", F.expr(rf"filter(split(__text, r'{_WHITE}+'), x -> x <> '')"))
    lines = F.expr(rf"filter(split(__text, '\n'), x -> x rlike r'{_LINE_WITH_WORD}')")
    split = split.withColumn("__lines", lines)
    counted = split.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        _removed("[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _removed(r"\p{Lu}").cast("long").alias("n_capitals"),
        _removed("[0-9]").cast("long").alias("n_digits"),
        F.transform("__words", lambda x: F.xxhash64(x)).alias("__hashes"),
    )
    parts = ", ".join(f"__hashes[i + {k}]" for k in range(WINDOW))
    windows = counted.withColumn(
        "__windows",
        F.expr(
            f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {WINDOW}),"
            f" i -> xxhash64({parts})) ELSE CAST(array() AS ARRAY<BIGINT>) END"
        ),
    )
    # Only texts with a repeated window sort theirs.
    ordered = windows.withColumn(
        "__sorted",
        F.expr(
            "CASE WHEN size(array_distinct(__windows)) < size(__windows) THEN"
            " array_sort(transform(__windows, (x, i) -> struct(x AS h, i AS at))) END"
        ),
    )
    repeated = ordered.withColumn(
        "__repeated",
        F.expr(
            "array_sort(transform(filter(__sorted, (x, i) -> x.h = get(__sorted, i - 1).h"
            " OR x.h = get(__sorted, i + 1).h), x -> x.at))"
        ),
    )
    covered = F.expr(
        "coalesce(aggregate(__repeated, struct(0L AS n, 0 AS done), (a, i) -> struct("
        f"a.n + i + {WINDOW} - greatest(i, a.done) AS n, i + {WINDOW} AS done)).n, 0L)"
    )
    whole = repeated.withColumn("n_repeat_words", covered)
    # A generator keeps the optimizer from copying the long expressions into filters on counts.
    counts = F.struct(*_COUNTS, "n_lines", "n_capitals", "n_digits")
    return whole.select(*own, F.explode(F.array(counts)).alias("__counts")).select(*own, "__counts.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Adds the condition with the most information gained until no good document is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for name, values in table.items():
            x, y = values[inside], bad[inside]
            for threshold in np.unique(np.quantile(x, np.linspace(0.005, 0.995, cuts))):
                for above in (True, False):
                    hit = x > threshold if above else x <= threshold
                    p, n = y[hit].sum(), hit.sum()
                    if p:
                        found = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if found > gain:
                            best, gain = Condition(name, above, float(threshold)), found
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The start of the rule that does best on documents it was not grown on, and how well."""
    best: tuple[Rule, float, int] = ((), -1.0, 0)
    for k in range(1, len(rule) + 1):
        hit = _holds(rule[:k], table, len(bad))
        n = int(hit.sum())
        precision = float(bad[hit].mean()) if n else 0.0
        if precision > best[1]:
            best = (rule[:k], precision, n)
    return best


def learn_list(
    table: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.97,
    least: int = 5,
    rules: int = 24,
    conditions: int = 4,
    cuts: int = 48,
) -> list[Rule]:
    """Ordered rules for bad documents; rows are dealt to growing and pruning by their place.

    A rule enters if, on the pruning rows that the list still leaves, at least ``least`` are
    covered and the share of bad ones is at least ``precision``.
    """
    grown = np.arange(len(bad)) % 3 != 0
    left = np.ones(len(bad), bool)
    out: list[Rule] = []
    while len(out) < rules:
        g, p = grown & left, ~grown & left
        if not bad[g].any() or not bad[p].any():
            break
        rule = _grow({k: v[g] for k, v in table.items()}, bad[g], conditions, cuts)
        if not rule:
            break
        rule, right, n = _prune(rule, {k: v[p] for k, v in table.items()}, bad[p])
        if n < least or right < precision:
            break
        out.append(rule)
        left &= ~_holds(rule, table, len(bad))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from ``labels(doc_id, quality)``, 0 for low quality.

    At most ``sample`` labelled documents are used, and only their texts are measured. Labels
    that are null or without a document are left out; of several for one document the lowest
    counts. Without labels the list is empty.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = text_statistics(texts.join(F.broadcast(chosen), "doc_id"))
    features = [F.max(F.expr(x).cast("double")).alias(k) for k, x in FEATURES.items()]
    bad = F.max((F.col("quality") == 0).cast("int")).alias("bad")
    rows = measured.groupBy("doc_id").agg(*features, bad).collect()
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"]))
    table = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn_list(table, np.array([r["bad"] == 1 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """True for a document that no rule rejects: the first rule that holds decides."""
    out = None
    for rule in rules:
        condition = F.expr(" AND ".join(x.sql() for x in rule))
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to every document, one row per input row.

    Too few words or too many repeated ones fail the base rule and are not kept; else the list
    decides. A null or empty text has no words and fails. Columns of ``docs`` named like a
    result are replaced.
    """
    measured = text_statistics(docs.drop(*_RESULTS))
    failed = measured.withColumn("base_failed", F.expr(BASE_FAILED))
    kept = ~F.col("base_failed") & verdict(rules)
    return failed.withColumn("kept", kept).drop("n_lines", "n_capitals", "n_digits")


_RESULTS = (*_COUNTS, "n_lines", "n_capitals", "n_digits", "base_failed", "kept")
