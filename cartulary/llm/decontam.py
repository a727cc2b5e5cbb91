"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over the benchmark's words, the only ones that a match
can be made of. A distributed randomised SVD finds their leading directions: the passages and their
transpose are multiplied by a random test matrix in one pass, and the product's small core gives
the right singular vectors and the singular values (Nystrom's form). Passages and benchmark items
are folded into the space, each direction divided by its singular value, so what all passages
share weighs little. Windows near an item by cosine are candidates. A candidate is confirmed where
the longest common subsequence of words covers enough of the item and enough of its answer, the
item's last part. What confirms an item has all but a quarter of its words, so most of its rarest
ones; windows without enough rare words of any item are left out before any cosine, which loses
none that could be confirmed.

Copies need no cosine: a run of ``RUN`` words of an item, or a shorter item whole, confirms it
wherever it stands. Long items are looked for in parts.

Only sums over passages reach the driver: frequencies of the benchmark's words and matrices of
their number times the rank. Texts become word numbers once, kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import U64, stored, text_chunks, words

#: Words of a passage in the statistics, and of the blocks that windows are made of.
PASSAGE = 32
UNIT = 8
#: Directions kept, and more that are drawn for accuracy.
RANK = 64
EXTRA = 8
#: Lengths of windows in blocks, and their strides.
WINDOWS = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 10: 2, 12: 3, 16: 4}
#: Least cosine of a candidate. The filter by rare words leaves few windows, so it can be low.
NEAR = 0.1
#: Share of an item's words, the rarest, that the filter counts; above what a match may lack.
RAREST = 0.4
#: Words of an item that confirm it when copied in a row.
RUN = 13
#: Words of the longest part that is looked for as one.
PART = 96
#: Windows and items whose cosines are computed at once.
TILE = 2048
#: Least share of the item's words in order, and of its answer's.
SHARED = 0.75
ANSWER = 0.5
#: A share of the item this high needs no answer check.
SURE = 0.9
#: Items with fewer words have too few to miss any, and are only looked for as copies.
SHORTEST = 8
#: Benchmark items handled in one run over the documents.
ITEMS = 20_000
#: Groups that partial sums are first added up in.
SALTS = 64
#: Rows of a matrix that are added up together.
SLICE = 512

_LETTERS = np.zeros(256, bool)
_LETTERS[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _LETTERS[ord(_a) : ord(_b) + 1] = True


@dataclass(frozen=True)
class Items:
    """Benchmark items as numbers of their words; ``vocabulary`` holds the words' sorted hashes."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray


def read_items(rows: list[tuple[object, str | None]]) -> Items:
    ids, hashed = [], []
    for item_id, text in rows:
        data = np.frombuffer((text or "").lower().encode(), np.uint8)
        found, _ = words(data, np.array([0, len(data)]), _LETTERS)
        if len(found):
            ids.append(item_id)
            hashed.append(found)
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, U64)
    return Items(ids, [np.searchsorted(vocabulary, x).astype(np.int64) for x in hashed], vocabulary)


def _numbered(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, words``: the number of each word of the benchmark plus 1, others 0."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = np.uint16 if len(vocabulary) < 65_535 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch["text"]):
                hashes, places = words(data, offsets, _LETTERS)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                numbers = np.where(known[at] == hashes, at + 1, 0).astype(kind)
                rows = [numbers[a:b].tobytes() for a, b in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][first:end], pa.array(rows, pa.binary())], ["doc_id", "words"]
                )

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")
    )
    return read.mapInArrow(run, "doc_id long, words binary")


def _batches(
    column: pa.Array, kind: type, unit: int, pad: int = 0, most: int = 1 << 19
) -> Iterator[tuple]:
    """First row, word numbers from -1, and the unit of each word, cut anew in each row.

    Also gives the first unit of each row, which ends with ``pad`` empty units, and the place of
    its first word. Long rows come alone.
    """
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    first = 0
    while first < len(rows):
        end, total = first, 0
        while end < len(rows) and (end == first or total + len(rows[end]) <= most):
            total += len(rows[end])
            end += 1
        own = rows[first:end]
        sizes = np.array([len(x) for x in own])
        units = -(-sizes // unit) + pad
        heads = np.append(0, np.cumsum(units))
        places = np.append(0, np.cumsum(sizes))
        numbers = np.concatenate(own).astype(np.int32) - 1
        within = np.arange(len(numbers), dtype=np.int32) - np.repeat(places[:-1], sizes).astype(np.int32)
        of = np.repeat(heads[:-1], sizes).astype(np.int32) + within // np.int32(unit)
        yield first, numbers, of, heads, places
        first = end


def _summed(partial: DataFrame) -> dict[int, np.ndarray]:
    """Adds up arrays by ``slice``, first within salts; returns them to the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in pdf["data"])
        return pd.DataFrame(
            {"slice": pdf["slice"][:1], "salt": pdf["salt"][:1], "data": [total.tobytes()]}
        )

    kind = "slice int, salt int, data binary"
    once = partial.groupBy("slice", "salt").applyInPandas(add, kind)
    rows = once.groupBy("slice").applyInPandas(add, kind).collect()
    return {r["slice"]: np.frombuffer(r["data"], np.float64) for r in rows}


def _partial(numbered: DataFrame, kind: type, start, step, end) -> DataFrame:
    """Arrays that each task adds up over its passages, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        state = start()
        for batch in batches:
            for _, numbers, unit, heads, _ in _batches(batch["words"], kind, PASSAGE):
                known = numbers >= 0
                if known.any():
                    step(state, numbers[known], unit[known], int(heads[-1]))
        salt = TaskContext.get().partitionId() % SALTS
        for i, part in end(state):
            data = np.ascontiguousarray(part, np.float64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())],
                ["slice", "salt", "data"],
            )

    return numbered.select("words").mapInArrow(run, "slice int, salt int, data binary")


def _slices(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for i, at in enumerate(range(0, len(matrix), SLICE)):
        yield i, matrix[at : at + SLICE]


def _joined(parts: dict[int, np.ndarray], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    for i, part in parts.items():
        out[i * SLICE : (i + 1) * SLICE] = part.reshape(-1, columns)
    return out


def _added(to: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``values[of]`` by ``to``, for n rows; column by column, which is fastest."""
    out = np.empty((n, values.shape[1]), np.float32)
    for j, column in enumerate(np.ascontiguousarray(values.T)):
        out[:, j] = np.bincount(to, column[of], n)
    return out


def latent_space(
    numbered: DataFrame, kind: type, size: int, rank: int, extra: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Maps word numbers to latent coordinates, the rows weighted and divided by singular values.

    Also gives the passages that hold each word.
    """

    def count_start():
        return [np.zeros(size), 0]

    def count(state, numbers, unit, n):
        pairs = np.unique(unit.astype(np.int64) * size + numbers)
        state[0] += np.bincount(pairs % size, minlength=size)
        state[1] += n

    def count_end(state):
        yield from _slices(state[0].reshape(-1, 1))
        yield -1, np.array([state[1]])

    sums = _summed(_partial(numbered, kind, count_start, count, count_end))
    passages = float(sums.pop(-1, np.zeros(1))[0])
    frequency = _joined(sums, size, 1)[:, 0]
    weight = np.log((1 + passages) / (1 + frequency))

    columns = min(rank + extra, size)
    test = np.random.default_rng(seed).standard_normal((size, columns))
    sc = numbered.sparkSession.sparkContext
    there = sc.broadcast((weight[:, None] * test).astype(np.float32))

    def product_start():
        return np.zeros((size, columns))

    def product(state, numbers, unit, n):
        state += _added(numbers, _added(unit, there.value, numbers, n), unit, size)

    image = _joined(_summed(_partial(numbered, kind, product_start, product, _slices)), size, columns)
    # With C the passages' Gram matrix, image is C times test; C is near image core^-1 image^T.
    image *= weight[:, None]
    core = test.T @ image
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 1e-12) * 1e-10
    half = image @ (turn[:, good] / np.sqrt(values[good]))
    right, singular, _ = np.linalg.svd(half, full_matrices=False)
    kept = singular[:rank] > max(singular[:1], default=0.0) * 1e-6
    right, singular = right[:, :rank][:, kept], singular[:rank][kept]
    if not len(singular):
        return np.zeros((size, 1), np.float32), frequency
    return (weight[:, None] * right / singular).astype(np.float32), frequency


def common_subsequence(masks: dict[int, int], n: int, numbers: list[int]) -> int:
    """Length of the longest common subsequence with a sequence given by the bits of its words."""
    ones = (1 << n) - 1
    state = ones
    for x in numbers:
        m = masks.get(x)
        if m:
            state = ((state + (state & m)) | (state & ~m)) & ones
    return n - state.bit_count()


def word_bits(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(sequence):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Item:
    """What is looked for: the whole item, and its answer, the last quarter of its words."""

    def __init__(self, item_id, sequence: np.ndarray) -> None:
        whole = sequence.tolist()
        answer = whole[-max(3, len(whole) // 4) :]
        self.item_id, self.n, self.n_answer = item_id, len(whole), len(answer)
        self.bits, self.answer_bits = word_bits(whole), word_bits(answer)

    def confirm(self, numbers: list[int]) -> tuple[float, float] | None:
        # Words that the item has at all bound what the two have in order.
        if sum(map(self.bits.__contains__, numbers)) < SHARED * self.n:
            return None
        shared = common_subsequence(self.bits, self.n, numbers) / self.n
        if shared < SHARED:
            return None
        answer = common_subsequence(self.answer_bits, self.n_answer, numbers) / self.n_answer
        return (shared, answer) if shared >= SURE or answer >= ANSWER else None


def parts_of(n: int) -> list[slice]:
    """The parts that an item of n words is looked for in, of about equal length."""
    count = -(-n // PART)
    edges = [n * i // count for i in range(count + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class Copies:
    """Runs of words that confirm an item: ``RUN`` of them, or all of a shorter one."""

    _BASE = U64(0x9E3779B97F4A7C15)

    def __init__(self, items: Items) -> None:
        self.items = items
        runs: dict[int, list[tuple[int, int]]] = {}
        for i, sequence in enumerate(items.words):
            n = min(RUN, len(sequence))
            runs.setdefault(n, []).extend((i, at) for at in range(len(sequence) - n + 1))
        self.runs = {}
        for n, found in runs.items():
            digests = np.array(
                [int(self._digests(items.words[i], np.array([at]), n)[0]) for i, at in found], U64
            )
            order = np.argsort(digests, kind="stable")
            self.runs[n] = digests[order], np.array(found)[order]

    def _digests(self, numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), U64)
        for k in range(n):
            out = (out + numbers[at + k].astype(U64) + U64(1)) * self._BASE
            out ^= out >> U64(29)
        return out

    def find(self, numbers: np.ndarray, places: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """First word and copied words of each ``row, item``; rows are ``places`` of ``numbers``."""
        unknown = np.append(0, np.cumsum(numbers < 0))
        row_end = np.repeat(places[1:], np.diff(places))
        first: dict[tuple[int, int], int] = {}
        held: dict[tuple[int, int], set[int]] = {}
        for n, (digests, runs) in self.runs.items():
            if n > len(numbers):
                continue
            at = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n])
            at = at[at + n <= row_end[at]]
            if not len(at):
                continue
            own = self._digests(numbers, at, n)
            low = np.searchsorted(digests, own, "left")
            high = np.searchsorted(digests, own, "right")
            for k in np.flatnonzero(high > low).tolist():
                begin = int(at[k])
                row = int(np.searchsorted(places, begin, "right")) - 1
                for item, start in runs[low[k] : high[k]].tolist():
                    if (numbers[begin : begin + n] == self.items.words[item][start : start + n]).all():
                        key = row, item
                        first[key] = min(first.get(key, begin), begin)
                        held.setdefault(key, set()).update(range(start, start + n))
        return {k: (x - int(places[k[0]]), len(held[k])) for k, x in first.items()}


@dataclass(frozen=True)
class Scale:
    """The parts that windows of one length are compared with.

    A match has all but a quarter of a part's words, so of its rarest words, a larger share, it has
    at least ``least``; they stand within ``around`` blocks of the window.
    """

    length: int
    members: np.ndarray
    rare: np.ndarray
    least: int
    around: int

    def starts(self, numbers: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
        """First blocks, of n, of the windows that may hold a match."""
        counts = np.bincount(unit[self.rare[numbers]], minlength=n)
        upto = np.append(0, np.cumsum(counts))
        starts = np.arange(0, n, WINDOWS[self.length])
        low = np.maximum(starts - self.around, 0)
        high = np.minimum(starts + self.length + self.around, n)
        return starts[upto[high] - upto[low] >= self.least]


def _scales(parts: list[np.ndarray], frequency: np.ndarray) -> list[Scale]:
    lengths = sorted(WINDOWS)
    # The shortest windows that hold a part; a shorter one might stand at its edge.
    nearest = np.array([next((w for w in lengths if w * UNIT >= len(x)), lengths[-1]) for x in parts])
    out = []
    for w in sorted(set(nearest.tolist())):
        members = np.flatnonzero(nearest == w)
        rare, least, longest = np.zeros(len(frequency), bool), [], 0
        for x in (parts[i] for i in members):
            n = len(x)
            counted = int(np.ceil(RAREST * n))
            rare[x[np.argsort(frequency[x], kind="stable")[:counted]]] = True
            least.append(counted - (n - int(np.ceil(SHARED * n))))
            longest = max(longest, n)
        out.append(Scale(w, members, rare, min(least), -(-(longest // 2) // UNIT)))
    return out


_FOUND = (
    "doc_id long, item long, first_word long, cosine double, shared double, answer double, copied long"
)


class Search:
    """What a worker needs to look for the items in word numbers."""

    def __init__(self, items: Items, space: np.ndarray, frequency: np.ndarray) -> None:
        self.copies, self.space = Copies(items), space
        self.of, parts = [], []
        for i, x in enumerate(items.words):
            for part in parts_of(len(x)) if len(x) >= SHORTEST else []:
                self.of.append(i)
                parts.append(x[part])
        self.wanted = [Item(i, x) for i, x in zip(self.of, parts, strict=True)]
        self.scales = _scales(parts, frequency)
        self.longest = max((s.length for s in self.scales), default=1)
        self.vectors = np.stack([space[x].sum(0) for x in parts]) if parts else np.zeros((0, space.shape[1]))
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)

    def _near(self, numbers: np.ndarray, unit: np.ndarray, n: int) -> Iterator[tuple[int, int, int, float]]:
        """Window's first block, its length in blocks, part and cosine of the candidates."""
        kept = [(s, s.starts(numbers, unit, n)) for s in self.scales]
        needed = np.zeros(n, bool)
        for s, starts in kept:
            for k in range(s.length):
                needed[np.minimum(starts + k, n - 1)] = True
        place = np.cumsum(needed) - 1
        own = needed[unit]
        blocks = _added(place[unit[own]], self.space, numbers[own], int(needed.sum()))
        for s, all_starts in kept:
            for at in range(0, len(all_starts), TILE):
                starts = all_starts[at : at + TILE]
                total = blocks[place[starts]]
                for k in range(1, s.length):
                    inner = starts + k < n
                    total[inner] += blocks[place[starts[inner] + k]]
                size = np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-9)
                for first in range(0, len(s.members), TILE):
                    members = s.members[first : first + TILE]
                    cosines = (total @ self.vectors[members].T) / size[:, None]
                    for w, i in zip(*np.nonzero(cosines >= NEAR), strict=True):
                        yield int(starts[w]), s.length, int(members[i]), float(cosines[w, i])

    def rows(
        self, numbers: np.ndarray, unit: np.ndarray, heads: np.ndarray, places: np.ndarray
    ) -> Iterator[tuple]:
        """``row, item`` and the rest of a result for what is found in some rows."""
        copied = self.copies.find(numbers, places)
        known = numbers >= 0
        best: dict[tuple[int, int], list[tuple]] = {}
        if known.any() and self.scales:
            for start, length, part, cosine in self._near(numbers[known], unit[known], int(heads[-1])):
                r = int(np.searchsorted(heads, start, "right")) - 1
                found = best.setdefault((r, self.of[part]), [])
                found.append((-cosine, start - int(heads[r]), length, part))
        for key in sorted(copied.keys() | best.keys()):
            r, item = key
            first, words = copied.get(key, (None, None))
            text = numbers[places[r] : places[r + 1]]
            right = None
            for cosine, a, length, part in sorted(best.get(key, [])):
                around = self.wanted[part].n // 2
                low = max(a * UNIT - around, 0)
                right = self.wanted[part].confirm(text[low : (a + length) * UNIT + around].tolist())
                if right:
                    yield r, item, a * UNIT if first is None else first, -cosine, *right, words
                    break
            if right is None and words:
                yield r, item, first, None, None, None, words


def _retrieve(numbered: DataFrame, kind: type, items: Items, space: np.ndarray, frequency: np.ndarray) -> DataFrame:
    sc = numbered.sparkSession.sparkContext
    shared = sc.broadcast((items, space, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        search = Search(*shared.value)
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), []
            for first, *of_rows in _batches(batch["words"], kind, UNIT, pad=search.longest - 1):
                rows += [(ids[first + r], *rest) for r, *rest in search.rows(*of_rows)]
            names = [x.split()[0] for x in _FOUND.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names
            )

    found = numbered.mapInArrow(run, _FOUND)
    spark = numbered.sparkSession
    names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return found.join(F.broadcast(names), "item").drop("item")


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, extra: int = EXTRA, seed: int = 7
) -> DataFrame:
    """``doc_id, item_id, first_word, cosine, shared, answer, copied``: items that documents contain.

    One row for each document row and ``benchmark(item_id, text)`` item found in it. ``copied`` is
    the number of the item's words that stand in runs copied word for word (null without one);
    ``cosine, shared, answer`` are those of the best confirmed window, null where only copies were
    found. Words are runs of letters and digits, lower-cased. The whole benchmark is compared,
    ``ITEMS`` at a time. Null and empty texts contain nothing, and items without words are not looked
    for; those of fewer than ``SHORTEST`` words only as copies. Repeated rows give repeated results;
    other columns are not read.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts = max(1, -(-rows.count() // ITEMS))
    out = None
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        items = read_items(sorted(map(tuple, own.collect()), key=str))
        if not items.ids:
            continue
        kind = np.uint16 if len(items.vocabulary) < 65_535 else np.uint32
        numbered = stored(_numbered(docs, items.vocabulary), "words")
        space, frequency = latent_space(numbered, kind, len(items.vocabulary), rank, extra, seed)
        found = _retrieve(numbered, kind, items, space, frequency)
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = _FOUND.replace("item long", "item_id long")
        out = docs.sparkSession.createDataFrame([], none)
    return out.select("doc_id", "item_id", "first_word", "cosine", "shared", "answer", "copied")
