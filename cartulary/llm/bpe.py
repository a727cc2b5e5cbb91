"""Byte-level pair merging with a segment tree, and decoding.

A text is split into pre-tokens by the vocabulary's pattern; each is merged alone. Over the byte
positions of a pre-token stands a segment tree of minima. The leaf of a live position holds the
rank of the pair that starts there, with the position in the lower bits, so the root is the
leftmost pair of least rank. A merge changes three leaves, that of the pair, of its second part and
of the live neighbour before it, each in logarithmic time. A pre-token that is a vocabulary string
is that one token, as the vocabulary's own library has it.

Ids of a pre-token met before are looked up; a worker remembers a bounded number of short ones.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens a worker remembers, and the most characters of one.
REMEMBERED = 300_000
LONGEST = 64
#: Characters of text whose pre-tokens are looked up together; a longer text is taken in parts.
TOGETHER = 1 << 20
#: Pre-tokens taken at a time from a longer text, and new ones merged at a time.
PIECES, MERGED = 65_536, 16_384

_NONE = (1 << 63) - 1


#: Pre-tokens of more bytes keep their tree in compact arrays.
COMPACT = 512


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token; at most 48 bytes of memory for a byte of a long one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    bits = n.bit_length()
    here = (1 << bits) - 1
    rank_of = ranks.get
    # The tree: node i has the children 2i and 2i + 1, position p is node size + p.
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))
    if n > COMPACT:
        tree, after, before = array("q", tree), array("q", after), array("q", before)
    for p in range(n - 1):
        rank = rank_of(piece[p : p + 2])
        if rank is not None:
            tree[size + p] = rank << bits | p
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    while (least := tree[1]) != _NONE:
        start = least & here
        second = after[start]
        end = after[second]
        after[start] = end
        before[end] = start
        changed = [(second, None)]
        changed.append((start, rank_of(piece[start : after[end]]) if end < n else None))
        left = before[start]
        if left >= 0:
            changed.append((left, rank_of(piece[left:end])))
        for p, rank in changed:
            low = _NONE if rank is None else rank << bits | p
            i = size + p
            tree[i] = low
            while i > 1:
                other = tree[i ^ 1]
                if other < low:
                    low = other
                i >>= 1
                if tree[i] == low:
                    break
                tree[i] = low
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Trees:
    """Segment trees of many short pre-tokens, side by side: a step is one merge in each."""

    #: Leaves of a tree; a longer pre-token has a tree of its own.
    WIDTHS = (8, 16, 32, 64)
    #: No token; no pair has it.
    END = (1 << 17) - 1

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
                if first is not None and second is not None:
                    pairs[first << 17 | second] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)
        #: Ranks of pairs of bytes.
        self.doubles = np.full(1 << 16, _NONE)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.doubles[token[0] << 8 | token[1]] = rank

    def _keys(self, first: np.ndarray, second: np.ndarray, position: np.ndarray) -> np.ndarray:
        pair = first << 17 | second
        at = np.minimum(self.pairs.searchsorted(pair), len(self.pairs) - 1)
        return np.where(self.pairs.take(at) == pair, self.ranks.take(at) << 6 | position, _NONE)

    def merged(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Little-endian 32-bit ids of pre-tokens of at most ``width`` bytes, none of them empty."""
        n, place = len(pieces), np.arange(width)
        sizes = np.array(list(map(len, pieces)))
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8)
        live = place < sizes[:, None]
        ids = np.full((n, width + 1), self.END)
        ids[:, :-1] = np.where(live, self.single.take(raw).reshape(n, width), self.END)
        tree = np.full((n, 2 * width), _NONE)
        rows, places = np.nonzero(live[:, 1:])
        pairs = raw.reshape(n, width).astype(np.int64)
        key = self.doubles.take(pairs[rows, places] << 8 | pairs[rows, places + 1])
        tree[rows, width + places] = np.where(key == _NONE, _NONE, key << 6 | places)
        for low in _levels(width):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        # From here on by place in the flat arrays, which is faster.
        after = np.minimum(place + 1, sizes[:, None]).ravel()
        before = np.tile(place - 1, n)
        alive, ids, tree = live.ravel(), ids.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            least = tree.take(rows * (2 * width) + 1)
            going = least != _NONE
            rows, least = rows[going], least[going]
            if not len(rows):
                break
            own, own_ids, root = rows * width, rows * (width + 1), rows * (2 * width)
            start, here = least & 63, least >> 6
            ids[own_ids + start] = here
            second = after.take(own + start)
            last = second == width - 1
            end = np.where(last, width, after.take(own + second))
            after[own + start] = end
            inner = end < width
            before[(own + end)[inner]] = start[inner]
            alive[own + second] = False
            left = before.take(own + start)
            first = left < 0
            left = np.where(first, start, left)
            key = self._keys(here, ids.take(own_ids + end), start)
            key_left = np.where(first, key, self._keys(ids.take(own_ids + left), here, left))
            node = width + np.concatenate([second, start, left])
            root = np.concatenate([root, root, root])
            low = np.concatenate([np.full(len(rows), _NONE), key, key_left])
            tree[root + node] = low
            for _ in _levels(width):
                low = np.minimum(tree.take(root + node), tree.take(root + (node ^ 1)))
                node >>= 1
                tree[root + node] = low
        data = ids.reshape(n, width + 1)[:, :-1][live].astype("<i4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _levels(width: int) -> list[int]:
    """First nodes of the levels above the leaves, from the lowest up."""
    return [1 << k for k in range(width.bit_length() - 2, -1, -1)]


class Encoder:
    """Ids of texts as little-endian 32-bit values, and the bytes of ids."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(ranks_path)
        self.strings = {i: x for x, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.trees = Trees(self.ranks)

        class Known(dict):
            fresh: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                return self.fresh[piece]

        self.known = Known()

    def _learn(self, pieces: set[str]) -> None:
        """Merge pre-tokens not met before; the first met are the most frequent and stay."""
        fresh = self.known.fresh = {}
        by_width: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in Trees.WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            size = len(raw)
            if raw in self.ranks or size > Trees.WIDTHS[-1]:
                fresh[piece] = np.array(merged(raw, self.ranks), "<i4").tobytes()
                continue
            some, raws = by_width[8 if size <= 8 else 16 if size <= 16 else 32 if size <= 32 else 64]
            some.append(piece)
            raws.append(raw)
        for width, (some, raws) in by_width.items():
            for at in range(0, len(some), MERGED):
                found = self.trees.merged(raws[at : at + MERGED], width)
                fresh.update(zip(some[at : at + MERGED], found, strict=True))
        if (room := REMEMBERED - len(self.known)) > 0:
            self.known.update(x for x in islice(fresh.items(), room) if len(x[0]) <= LONGEST)

    def _looked_up(self, lists: list[list[str]]) -> list[bytes]:
        self._learn(set().union(*lists).difference(self.known))
        look_up = self.known.__getitem__
        return [b"".join(map(look_up, pieces)) for pieces in lists]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; texts of little more than ``TOGETHER`` characters in all, or one."""
        if len(texts) == 1 and len(texts[0]) > TOGETHER:
            found = (m[0] for m in self.pattern.finditer(texts[0]))
            parts = iter(lambda: list(islice(found, PIECES)), [])
            return [b"".join(self._looked_up([part])[0] for part in parts)]
        return self._looked_up([self.pattern.findall(text) for text in texts])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, one row per input row.

    A null or empty text has no ids. Strings of special tokens are ordinary text. Repeated rows give
    repeated results, an empty table no rows; other columns are not read. ``ranks_path`` is a file
    that every executor has. The pattern must cover every character, or decoding gives less.
    """

    def made(keys: list[int | None], texts: list[str]) -> pa.RecordBatch:
        parts = _encoder(ranks_path, pattern).ids(texts)
        offsets = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py() or ""
                if keys and size + len(text) > TOGETHER:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(doc_id.as_py())
                texts.append(text)
                size += len(text)
            if keys:
                yield made(keys, texts)

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return read.mapInArrow(run, "doc_id long, ids array<int>")


#: Bytes of decoded text in one batch of results, a longer document alone.
BATCH = 8 << 20


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for; null ids decode to nothing.

    An id that is not in the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size = 0, 0
            out: list[bytes] = []
            for row, ids in enumerate(batch["ids"]):
                own = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                out.append(_encoder(ranks_path, pattern).decode(own))
                size += len(out[-1])
                if size >= BATCH or row + 1 == batch.num_rows:
                    part = batch.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"], part["ids"], pa.array(out, pa.binary())],
                        ["doc_id", "ids", "decoded"],
                    )
                    first, size, out = row + 1, 0, []

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded documents."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
