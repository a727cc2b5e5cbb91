"""Language identification by prediction by partial matching.

One variable-order byte model per language: contexts of two, one and no bytes. A byte seen after a
context costs its share there; one not seen costs an escape and is coded in the next shorter
context, at last uniformly (escape method C: a context with n bytes seen, d of them different,
escapes with d / (n + d)). The statistics are frozen after training, so a text's code length under
a language is a sum over its bytes and can be looked up. The shortest code wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import text_chunks

UNKNOWN = "und"

#: Texts start in the context of two line feeds.
_PAD = 10


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte with the two before it, and the bounds of the rows in them."""
    n = len(data)
    one, two = np.full(n, _PAD, np.uint32), np.full(n, _PAD, np.uint32)
    one[1:] = data[:-1]
    two[2:] = data[:-2]
    heads = offsets[:-1][np.diff(offsets) > 0]
    one[heads] = _PAD
    two[heads] = _PAD
    second = heads + 1
    second = second[second < n]
    two[second] = _PAD
    return (two << np.uint32(16)) | (one << np.uint32(8)) | data, offsets


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, code, n``: how often each byte follows each two, over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            names, of = langs.dictionary.to_pylist(), np.asarray(langs.indices)
            for first, end, data, offsets in text_chunks(batch["text"]):
                codes, _ = _trigrams(data, offsets)
                row_lang = np.repeat(of[first:end], np.diff(offsets))
                for i in np.unique(of[first:end]):
                    found, n = np.unique(codes[row_lang == i], return_counts=True)
                    if names[i] in held:
                        more, counts = held[names[i]]
                        found, back = np.unique(np.concatenate([more, found]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([counts, n]), len(found))
                        n = n.astype(np.int64)
                    held[names[i]] = found, n
        for lang, (found, n) in held.items():
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part)),
                        pa.array(part.astype(np.int32)),
                        pa.array(n[at : at + 100_000].astype(np.int64)),
                    ],
                    ["lang", "code", "n"],
                )

    partial = labelled.select("lang", "text").mapInArrow(run, "lang string, code int, n long")
    return partial.groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Frozen:
    """Code lengths in bits, a column for each language.

    ``codes`` are the trigrams seen in any language and ``cost`` their lengths; another trigram
    costs ``escape`` of its first two bytes and ``pair`` of its last two.
    """

    langs: list[str]
    codes: np.ndarray
    cost: np.ndarray
    escape: np.ndarray
    pair: np.ndarray


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Frozen:
    """The frozen statistics of ``lang -> (codes, counts)``."""
    langs = sorted(counts)
    codes = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, int)
    codes = codes.astype(np.int64)
    cost = np.zeros((len(codes), len(langs)), np.float32)
    escape = np.zeros((1 << 16, len(langs)), np.float32)
    pair = np.zeros((1 << 16, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        seen, n = (np.asarray(x, np.int64) for x in counts[lang])
        singles = np.bincount(seen & 0xFF, n, 256)
        pairs = np.bincount(seen & 0xFFFF, n, 1 << 16)
        kinds = np.count_nonzero(singles)
        total = singles.sum() + kinds
        # The shortest context: shares of all bytes, an escape to the uniform byte.
        zero = np.where(singles > 0, singles / total, kinds / total / 256)
        by_first = pairs.reshape(256, 256)
        n1, d1 = by_first.sum(1), (by_first > 0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = by_first / (n1 + d1)[:, None]
            leave = np.where(n1 > 0, d1 / (n1 + d1), 1.0)
        one = np.where(by_first > 0, share, leave[:, None] * zero[None, :])
        pair[:, j] = -np.log2(one).reshape(-1)
        context = seen >> 8
        n2 = np.bincount(context, n, 1 << 16)
        d2 = np.bincount(context, minlength=1 << 16)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape[:, j] = np.where(n2 > 0, -np.log2(d2 / (n2 + d2)), 0.0)
        cost[:, j] = escape[codes >> 8, j] + pair[codes & 0xFFFF, j]
        cost[np.searchsorted(codes, seen), j] = -np.log2(n / (n2 + d2)[context])
    return Frozen(langs, codes, cost, escape, pair)


def train(labelled: DataFrame) -> Frozen:
    """Frozen statistics of ``labelled(text, lang)``.

    What reaches the driver is one row per language and trigram of bytes, at most 2^24 for each
    language whatever the corpus, in practice some ten thousand.
    """
    rows = trigram_counts(labelled).toArrow()
    langs = rows["lang"].to_pylist()
    codes, n = np.asarray(rows["code"]), np.asarray(rows["n"])
    of = np.asarray(langs, object)
    return freeze({x: (codes[of == x], n[of == x]) for x in sorted(set(langs))})


class Scorer:
    """Code lengths by one look-up for each byte."""

    def __init__(self, model: Frozen) -> None:
        self.model = model
        n = len(model.codes)
        self.place = np.full(1 << 24, n, np.int32)
        self.place[model.codes] = np.arange(n, dtype=np.int32)
        self.cost = np.vstack([model.cost, np.zeros((1, len(model.langs)), np.float32)])

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        codes, _ = _trigrams(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.model.langs)))
        if not len(codes):
            return out
        place = self.place[codes]
        new = np.flatnonzero(place == len(self.model.codes))
        bits = self.cost[place]
        bits[new] = self.model.escape[codes[new] >> 8] + self.model.pair[codes[new] & 0xFFFF]
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    if id(shared.value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(shared.value)] = Scorer(shared.value)
    return _SCORERS[id(shared.value)]


def predict(docs: DataFrame, model: Frozen) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, one row per input row.

    ``score`` is the posterior of the language under equal priors. A null text, a text without a
    letter, and any text under a model without languages is ``und`` with score 0. Equal code
    lengths go to the first language by name. Only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch["lettered"].to_numpy(zero_copy_only=False).astype(bool)
            best = np.zeros(len(lettered), int)
            score = np.zeros(len(lettered))
            langs = shared.value.langs
            if langs:
                for first, end, data, offsets in text_chunks(batch["text"], 1 << 20):
                    bits = _scorer(shared).lengths(data, offsets)
                    best[first:end] = bits.argmin(1)
                    over = bits - bits.min(1, keepdims=True)
                    score[first:end] = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)
            known = lettered & bool(langs)
            names = [langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))],
                ["doc_id", "lang_pred", "score"],
            )

    text = F.col("text").cast("string")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double")


def bits_of(text: bytes, counts: dict[int, int]) -> float:
    """Code length of one text by walking the context tree, to test the tables against."""
    out = 0.0
    kids: dict[bytes, dict[int, int]] = {}
    for code, n in counts.items():
        a, b, c = code >> 16, code >> 8 & 255, code & 255
        for context in (bytes([a, b]), bytes([b]), b""):
            kids.setdefault(context, {}).setdefault(c, 0)
            kids[context][c] += n
    before = bytes([_PAD, _PAD])
    for x in text:
        for order in (2, 1, 0):
            seen = kids.get(before[len(before) - order :])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if x in seen:
                out -= math.log2(seen[x] / total)
                break
            out -= math.log2(len(seen) / total)
        else:
            out += 8
        before = before[-1:] + bytes([x])
    return out
