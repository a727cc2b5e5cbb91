"""What several operators share: reading tables, shared folders, words of Arrow text columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\v\f\r"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers started from a checkout look for the package where the driver found it.

    A cluster installs the package or sends it with ``--py-files``; the path is then unused.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see.

    Where it is unset, a folder in the session's warehouse, which they see as well.
    """
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return spark.conf.get("spark.checkpoint.dir", f"{warehouse}/_checkpoints")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(
    texts: pa.Array, limit: int = 4 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about ``limit`` bytes, a longer text alone.

    Gives first row, end row, the UTF-8 bytes and the row offsets in them. A null is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        own = offsets[first : end + 1]
        yield first, end, raw[own[0] : own[-1]], own - own[0]
        first = end


_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of words hashed at a time.
HASHED = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, HASHED + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), HASHED + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, A-Z as a-z, and per row the place of its first word.

    ``counts[i]:counts[i + 1]`` are the words of row i.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + HASHED, "right")))
        if ends[first] - begin > HASHED:
            sums[first] = _long_sum(data[begin : ends[first]])
        else:
            part = data[begin : int(ends[last - 1])]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum((LOWER[part].astype(U64) + U64(1)) * _UP[: len(part)], out=total[1:])
            start = starts[first:last] - begin
            sums[first:last] = (total[ends[first:last] - begin] - total[start]) * _DOWN[start]
        first = last
    return mix(sums), np.searchsorted(starts, offsets)


def _long_sum(word: np.ndarray) -> int:
    """The sum of one word that is longer than what is hashed at a time."""
    total = 0
    for at in range(0, len(word), HASHED):
        part = LOWER[word[at : at + HASHED]].astype(U64) + U64(1)
        own = int((part * _UP[: len(part)]).sum(dtype=U64))
        total = (total + own * pow(_BASE, at, 1 << 64)) % (1 << 64)
    return total
