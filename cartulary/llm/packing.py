"""Hierarchical multi-length packing.

A document's tokens are cut into full windows and a rest. A rest is routed to the context tier of
the least window that holds it. Tiers are packed from the longest down: a rest of the long tiers
opens a window, and its gap is filled from the tiers that fit, the largest rest first. What is left
of the short tiers shares windows in the same way. Sequences are then dealt into step groups of
about equal attention cost.

Packing needs lengths only, so ids stay in the task that made them. Documents are packed in groups
of a fixed number, chosen by a hash, which bounds a task's memory and leaves little padding.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import stored

#: Windows of the tiers; the last is the longest sequence.
TIERS = (128, 256, 512, 1024)
#: Documents packed together, on average.
GROUP_DOCS = 16_384
#: Sequences of one step group.
STEP = 64

#: Pre-tokens remembered by a worker, and the longest of them.
REMEMBERED = 500_000
LONGEST = 64

# Fixed value: the split pattern of the byte-level vocabulary, with its classes put in.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Characters below this, without rare spaces, have the same classes in every Unicode version.
_SAFE_END = 0x250
_RARE = set(range(0x1C, 0x20)) | {0x85, 0xA0}


def _class(kind: str) -> str:
    return "".join(chr(i) for i in range(_SAFE_END) if unicodedata.category(chr(i))[0] == kind)


class ByteLevelIds:
    """Ids of a byte-level vocabulary as little-endian bytes, pre-token by pre-token.

    Pre-tokens never merge with each other, so the ids of one met before are looked up and a new
    one is merged alone, by the ranks of the same vocabulary. Texts with characters outside the
    safe range or with an added token go to the library whole.
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        letters, numbers = re.escape(_class("L")), re.escape(_class("N"))
        pattern = SPLIT.replace("{L}", letters).replace("{N}", numbers)
        self.split = re.compile(pattern).findall
        safe = "".join(chr(i) for i in range(_SAFE_END) if i not in _RARE)
        self.unsafe = re.compile(f"[^{re.escape(safe)}]").search
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        merge = tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                out = struct.pack(f"<{len(ids := merge(piece))}I", *ids)
                # The first met are the most frequent; they stay.
                if len(self) < REMEMBERED and len(piece) <= LONGEST:
                    self[piece] = out
                return out

        self.known = Known()

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.added) or self.unsafe(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.split(text)))


@lru_cache(maxsize=1)
def _ids(path: str, ranks_path: str) -> ByteLevelIds:
    return ByteLevelIds(path, ranks_path)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"


def cut(docs: DataFrame, tokenizer_path: str, ranks_path: str, window: int, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids and ``end_id``: full windows and a rest.

    ``nth`` counts the documents of a task, so rows with one ``doc_id`` need not stay together. A
    task that runs again may see its rows in another order: write the pieces before dealing by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = int(end_id).to_bytes(4, "little")
        nth = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(
                batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True
            ):
                ids = (_ids(tokenizer_path, ranks_path).ids(text) if text else b"") + last
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n, nth))
                nth += 1
            names = [x.split()[0] for x in _PIECES.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return read.mapInArrow(run, _PIECES)


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if length <= t)


class Tier:
    """The pieces routed to one context size, by length."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[int]] = {}
        self.lengths: list[int] = []

    def add(self, i: int, n: int) -> None:
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(i)

    def take(self, most: int) -> tuple[int, int] | None:
        """The longest piece of at most ``most`` tokens, and its length."""
        at = bisect_right(self.lengths, most)
        if not at:
            return None
        n = self.lengths[at - 1]
        i = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.by_length[n]
            self.lengths.pop(at - 1)
        return i, n


def pack_lengths(lengths: list[int], tiers: tuple[int, ...]) -> list[list[int]]:
    """Indexes of the pieces of each sequence; no sequence is longer than the last tier.

    Each piece is routed to its tier. A piece of exactly its tier's window is a sequence without
    padding. Tiers are then packed from the longest down: the longest piece of a tier opens a long
    window, and its gap is filled from the tier that the gap belongs to and then from shorter ones,
    the longest piece that fits each time, until none does.
    """
    window = tiers[-1]
    pools = {t: Tier() for t in tiers}
    out = []
    for i, n in enumerate(lengths):
        tier = tier_of(n, tiers)
        if n == tier:
            out.append([i])
        else:
            pools[tier].add(i, n)
    falling = sorted(tiers, reverse=True)
    for tier in falling:
        while opened := pools[tier].take(window):
            i, n = opened
            sequence, left = [i], window - n
            while left:
                fits = (pools[t].take(left) for t in falling if t <= tier_of(left, tiers))
                filler = next((x for x in fits if x), None)
                if filler is None:
                    break
                sequence.append(filler[0])
                left -= filler[1]
            out.append(sequence)
    return out


def step_groups(costs: np.ndarray, step: int) -> np.ndarray:
    """Deals sequences to groups of at most ``step``, back and forth by falling cost."""
    n_groups = -(-len(costs) // step)
    order = np.argsort(-costs, kind="stable")
    place = np.arange(len(costs)) % (2 * n_groups)
    out = np.empty(len(costs), np.int64)
    out[order] = np.minimum(place, 2 * n_groups - 1 - place)
    return out


_PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, tier long, step_group long"
)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    tiers: tuple[int, ...] = TIERS,
    group_docs: int = GROUP_DOCS,
    step: int = STEP,
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Adds the ``tier`` of the piece and the ``step_group`` of its sequence. A null or empty text is
    the end id alone. Repeated rows are packed each; an empty table gives no rows; other columns
    are not read. ``sequence_id`` is unique, not gapless.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    window = tiers[-1]
    groups = max(1, -(-docs.count() // group_docs))
    pieces = stored(cut(docs, tokenizer_path, ranks_path, window), "pieces").withColumn(
        "pack_group", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(groups))
    )
    # A group with a missing id would turn all its ids into floating numbers.
    pieces = pieces.withColumn("known", F.col("doc_id").isNotNull()).fillna(0, ["doc_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["pack_group"].iat[0])
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence = np.empty(len(pdf), np.int64)
        offset = np.zeros(len(pdf), np.int64)
        packed = pack_lengths(lengths.tolist(), tiers)
        costs = np.zeros(len(packed))
        for s, members in enumerate(packed):
            at = 0
            for i in members:
                sequence[i], offset[i] = s, at
                at += int(lengths[i])
                costs[s] += float(lengths[i]) ** 2
        base = group << 31
        return pd.DataFrame(
            {
                **{x: pdf[x] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")},
                "known": pdf["known"],
                "sequence_id": base + sequence,
                "offset": offset,
                "tier": np.array(tiers)[np.searchsorted(tiers, lengths)],
                "step_group": base + step_groups(costs, step)[sequence],
            }
        )

    packed = pieces.groupBy("pack_group").applyInPandas(run, f"{_PACKED}, known boolean")
    return packed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
