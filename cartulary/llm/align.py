"""Alignment of two tokenizers by diagonal run skipping.

Both tokenizers cut the same bytes, so each gives a rising array of byte offsets at which its tokens
end. Where both have ends, the text falls into groups. As long as the tokens agree, the two arrays
are equal at one fixed shift of the index: probes of doubled length compare whole stretches of them
there, and halved ones find the first difference. What differs is an irregular group; the two
indexes walk on by the smaller end until the ends meet, which sets the next shift.

A byte-level vocabulary (A) encodes a space and the text; a piece vocabulary (B), which puts a mark
of that space itself, encodes the text. Every pair of an A and a B token in a group is a link. How
many documents hold a pair of ids linked is counted over the corpus; each document then gets the
counts of its links. Pairs held by very many documents are few, by a bound that follows from the
sum of the counts, and meet the documents by broadcast; the others are joined by a shuffle, in
which no key is then hot.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.bpe import read_ranks
from cartulary.llm.common import stored
from cartulary.llm.packing import ByteLevelIds
from cartulary.llm.tokens import MARK, proved_words

#: Characters of text aligned together; a longer text is cut between two words.
TOGETHER = 1 << 20
#: Words whose pieces a worker remembers, and the most characters of one.
REMEMBERED, LONGEST = 500_000, 64
#: Links of a group that are written one by one; in larger groups equal pairs are counted at once.
SMALL_GROUP = 64
#: Pairs that are broadcast, at most.
HOT_PAIRS = 1 << 18

_SPACED = re.compile(" *[^ ]+| +")
_BETWEEN_WORDS = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Rows ``a0, a1, b0, b1`` of the groups that are not one token to one token.

    Both arrays are 32-bit, rise, and end with the same value (or are both empty).
    """
    a, b = ends_a.tobytes(), ends_b.tobytes()
    at_a, at_b = memoryview(a).cast("i"), memoryview(b).cast("i")
    n, shift, i = 4 * len(at_a), 0, 0  # in bytes of the arrays, as slices compare fastest
    found = array("q")
    while i < n:
        step = 4
        while a[i : i + step] == b[i + shift : i + shift + step] and i < n:
            i += step
            step *= 2
        while step > 4:
            step //= 2
            if i < n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
        if i >= n:
            break
        x, y = i // 4, (i + shift) // 4
        found.extend((x, 0, y, 0))
        end_a, end_b = at_a[x], at_b[y]
        while end_a != end_b:
            if end_a < end_b:
                x += 1
                end_a = at_a[x]
            else:
                y += 1
                end_b = at_b[y]
        found[-3], found[-1] = x + 1, y + 1
        i, shift = 4 * (x + 1), 4 * (y - x)
    return np.frombuffer(found, np.int64).reshape(-1, 4)


def group_starts(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Indexes of the tokens that start a group, where ``first:end`` are the irregular ones."""
    inner = np.zeros(n + 1, np.int64)
    np.add.at(inner, first + 1, 1)
    np.add.at(inner, end, -1)
    return np.flatnonzero(np.cumsum(inner[:-1]) == 0)


class PieceIds:
    """Ids of a piece vocabulary, word by word where no piece can span two words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = proved_words(model) is not None
        self.strings = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                out = np.array(model.encode(word) if word else [model.piece_to_id(MARK)], "<i4").tobytes()
                if len(self) < REMEMBERED and len(word) <= LONGEST:
                    self[word] = out
                return out

        self.known = Known()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.model.encode(text), "<i4").tobytes()
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [x[1:] for x in _SPACED.findall(" " + text)]
        else:
            words = text.split(" ")
        return b"".join(map(self.known.__getitem__, words))


@dataclass
class _Document:
    """What is known of a document after some of its parts."""

    doc_id: int | None
    exact: bool = True
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    groups: list[bytes] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    def row(self) -> tuple:
        if not self.exact or not self.counts[0]:
            return (self.doc_id, 0, 0, 0, 0, "", [], [], [])
        pairs, times = _summed(np.concatenate(self.pairs), np.concatenate(self.times))
        # Every group ends with a semicolon but the last.
        groups = b"".join(self.groups)[:-1].decode()
        return (self.doc_id, *self.counts.tolist(), groups, pairs >> 17, pairs & 0x1FFFF, times)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


class Aligner:
    def __init__(self, json_path: str, ranks_path: str, model_path: str) -> None:
        self.a = ByteLevelIds(json_path, ranks_path)
        self.a.added, self.a.library.encode_special_tokens = [], True
        strings = {i: x for x, i in read_ranks(ranks_path).items()}
        self.strings_a = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.b = PieceIds(model_path)
        self.sizes_a, self.sizes_b = (
            np.array([len(x) for x in of], np.int32) for of in (self.strings_a, self.b.strings)
        )
        most = max(len(self.sizes_a), len(self.sizes_b))
        shown = [f"{i}{mark}".encode() for i in range(most) for mark in ",|;"]
        #: Decimal ids with what follows them: another of the group, the other side, the next group.
        self.shown = np.array(shown)

    def parts(self, text: str) -> list[str]:
        """The text without the spaces it is cut at: both tokenizers end a token before each."""
        out, at = [], 0
        while self.b.by_word and len(text) - at > TOGETHER:
            cut = _BETWEEN_WORDS.search(text, at + TOGETHER)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]] if at else [text]

    def add(self, parts: list[tuple[_Document, str]]) -> None:
        """Align a part of each document; those whose bytes are not given back lose all tokens."""
        taken, all_a, all_b = [], [], []
        for doc, text in parts:
            if not doc.exact or not text:
                continue
            ids_a = np.frombuffer(self.a.ids(" " + text), "<i4")
            ids_b = np.frombuffer(self.b.ids(text), "<i4")
            raw = (" " + text).encode()
            back_a = b"".join(map(self.strings_a.__getitem__, ids_a.tolist()))
            back_b = b"".join(map(self.b.strings.__getitem__, ids_b.tolist()))
            doc.exact = back_a == raw == back_b
            if doc.exact:
                taken.append(doc)
                all_a.append(ids_a)
                all_b.append(ids_b)
        if taken:
            self._link(taken, all_a, all_b)

    def _link(self, docs: list[_Document], all_a: list[np.ndarray], all_b: list[np.ndarray]) -> None:
        # All parts as one sequence: each ends with a group, so groups never span two of them.
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        ends = [np.cumsum(s[x], dtype=np.int32) for s, x in ((self.sizes_a, a), (self.sizes_b, b))]
        odd = irregular_groups(*ends)
        first_a = group_starts(len(a), odd[:, 0], odd[:, 1])
        first_b = group_starts(len(b), odd[:, 2], odd[:, 3])
        n_a, n_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)

        # The groups as text: A and B tokens of a group in turn, each with its mark.
        mark_a = np.zeros(len(a), np.int64)
        mark_b = np.zeros(len(b), np.int64)
        mark_a[first_a + n_a - 1] = 1
        mark_b[first_b + n_b - 1] = 2
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + first_b[of_a]] = 3 * a + mark_a
        shown[np.arange(len(b)) + (first_a + n_a)[of_b]] = 3 * b + mark_b

        begin_a = np.cumsum([0, *map(len, all_a)])
        begin_b = np.cumsum([0, *map(len, all_b)])
        begin = np.searchsorted(first_a, begin_a)
        doc_of = np.repeat(np.arange(len(docs)), np.diff(begin))

        small = n_a * n_b <= SMALL_GROUP
        links = n_a[small] * n_b[small]
        group = np.repeat(np.flatnonzero(small), links)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        pair = a[first_a[group] + nth // n_b[group]].astype(np.int64) << 17 | b[first_b[group] + nth % n_b[group]]
        keys, times = _summed(doc_of[group] << 34 | pair, np.ones(len(pair), np.int64))
        place = np.searchsorted(keys, np.arange(len(docs) + 1) << 34)
        for g in np.flatnonzero(~small):
            each_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            each_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            doc = docs[doc_of[g]]
            doc.pairs.append((each_a.astype(np.int64)[:, None] << 17 | each_b).ravel())
            doc.times.append((times_a[:, None] * times_b).ravel())
        linked = np.cumsum([0, *(n_a * n_b).tolist()])
        for k, doc in enumerate(docs):
            doc.counts += (
                begin_a[k + 1] - begin_a[k],
                begin_b[k + 1] - begin_b[k],
                begin[k + 1] - begin[k],
                linked[begin[k + 1]] - linked[begin[k]],
            )
            text = self.shown.take(shown[begin_a[k] + begin_b[k] : begin_a[k + 1] + begin_b[k + 1]])
            doc.groups.append(text.tobytes().translate(None, b"\0"))
            doc.pairs.append(keys[place[k] : place[k + 1]] & ((1 << 34) - 1))
            doc.times.append(times[place[k] : place[k + 1]])


@lru_cache(maxsize=1)
def _aligner(json_path: str, ranks_path: str, model_path: str) -> Aligner:
    return Aligner(json_path, ranks_path, model_path)


_ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups", pa.string()), ("pair_a", pa.list_(pa.int32())),
        ("pair_b", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ]
)


def align(docs: DataFrame, json_path: str, ranks_path: str, model_path: str) -> DataFrame:
    """Groups and links of each whole text, one row per input row.

    ``doc_id, n_a, n_b, n_groups, n_links``; ``groups`` as ``a1,a2|b1;a3|b2,b3`` in decimal ids; and
    the distinct linked pairs ``pair_a, pair_b``, each with the number of its links ``times``. A text
    that is null or empty, or that a tokenizer does not give back byte for byte (with the space before
    it), has no tokens: zeros, the empty text and empty lists. Special strings are plain text. Repeated
    rows give repeated results, an empty table no rows; other columns are not read. The three files
    are where every executor has them; ids are below 131,072.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(json_path, ranks_path, model_path)

        def made(done: list[_Document]) -> pa.RecordBatch:
            columns = zip(*(doc.row() for doc in done), strict=True)
            arrays = [pa.array(x, f.type) for x, f in zip(columns, _ALIGNED, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=_ALIGNED)

        for batch in batches:
            done, waiting, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc = _Document(doc_id.as_py())
                done.append(doc)
                text = text.as_py() or ""
                doc.exact = MARK not in text  # a mark is read as a space
                for part in aligner.parts(text):
                    waiting.append((doc, part))
                    size += len(part)
                    if size >= TOGETHER:
                        aligner.add(waiting)
                        waiting, size = [], 0
                if not waiting:
                    yield made(done)
                    done = []
            aligner.add(waiting)
            if done:
                yield made(done)

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    made_of = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string,"
        " pair_a array<int>, pair_b array<int>, times array<long>"
    )
    return read.mapInArrow(run, made_of)


def _entries(aligned: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pair_a", "pair_b", "times")).alias("e")
    return aligned.select("row_id", zipped).select(
        "row_id", F.col("e.pair_a").alias("a"), F.col("e.pair_b").alias("b"), "e.times"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n_docs, best``: documents that hold a pair linked, and if no pair of ``a`` has more.

    Counts combine before the shuffle. The highest counts are one row for each A id, so at most the
    A vocabulary, and are broadcast.
    """
    counts = (
        aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b")).alias("e"))
        .groupBy(F.col("e.pair_a").alias("a"), F.col("e.pair_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    counts = stored(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select(
        "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")
    )


def with_pair_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The columns of ``aligned`` but its lists, with ``n_best`` and ``count_sum``.

    ``n_best`` counts the links whose pair has the highest count of its A id, ties included;
    ``count_sum`` sums the counts over the links. A pair that holds at least one in ``hot_pairs``
    of all entries is broadcast; there are no more than ``hot_pairs`` of them.
    """
    rows = stored(aligned.withColumn("row_id", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows), "pairs")
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") * hot_pairs >= total
    entries = _entries(rows)
    marked = entries.join(F.broadcast(counts.where(is_hot)), ["a", "b"], "left")
    # A row for a broadcast pair has its counts already; what is left meets the other pairs.
    rest = marked.where("n_docs IS NULL").select("row_id", "a", "b", "times")
    met = marked.where("n_docs IS NOT NULL").unionByName(rest.join(counts.where(~is_hot), ["a", "b"]))
    sums = met.groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"),
    )
    plain = [x for x in aligned.columns if x not in ("pair_a", "pair_b", "times")]
    return (
        rows.select("row_id", *plain)
        .join(sums, "row_id", "left")
        .select(*plain, *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_best", "count_sum")))
    )
