"""N-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets are one class, and classes are linked by their sets:

1. Shingles in the order of their hashes: a class can have a partner only if enough of the first
   ones occur in another class. Counting that needs no pairs and leaves few classes.
2. The classes left learn how many classes hold each of their shingles, and offer the rarest ones,
   one more than a partner may miss. Classes that meet on such a shingle are tied to the least of
   them; ties are connected into neighbourhoods. No link leads out of a neighbourhood.
3. A neighbourhood is searched in memory. Most of its classes are near one of them, so its most
   typical class is compared with all first. The others look for partners by DivideSkip: their
   short inverted lists are merged through a heap, and what occurs often enough there is probed
   in the long lists by binary search. Classes already connected are not compared again.

Links are only needed as far as they connect, so a group of g copies gives g - 1 links. A
neighbourhood larger than a block is searched block against block.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import SPACES, U64, byte_table, mix, stored, text_chunks, words
from cartulary.llm.components import components

_IS_WORD = byte_table(SPACES)

#: Shingles that one task orders or counts at a time.
BUCKET = 1 << 20
#: Shingles of a neighbourhood searched at once.
BLOCK = 1 << 22
#: Postings of 16 bytes a map task gathers before it deals them out; sorting takes five times that.
FLUSH = 1 << 19
#: Bytes of text whose words are hashed together.
CHUNK = 1 << 20
#: Size of the filter that picks the classes left out of all texts; full, it lets more through.
FILTER_BITS = 1 << 26
#: DivideSkip's weight of the long lists.
MU = 0.01


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each row; with fewer words, all of them as one."""
    hashes, first = words(data, offsets, _IS_WORD)
    joint = np.zeros(max(len(hashes) - k + 1, 0), U64)
    for i in range(k):
        joint = joint * U64(0xD6E8FEB86659FD93) + hashes[i : i + len(joint)]
    joint = mix(joint)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            whole = U64(b - a)
            for x in hashes[a:b]:
                whole = U64((int(whole) * 0xA24BAED4963EE407 + int(x)) % (1 << 64))
            out.append(mix(np.array([whole], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set."""
    a = mix(values * U64(0x9FB21C651E98DF25)).sum(dtype=U64)
    b = mix(values ^ U64(0x632BE59BD9B4E019)).sum(dtype=U64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _first(n: int, percent: int) -> int:
    """Length of the start of a set, in any order, that shares ``_slack`` with a partner's."""
    return n - least_overlap(n, percent) + _slack(n)


def _slack(n: int) -> int:
    return max(1, n // 10)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, row_key, n, fp, fp2``: the size and the digests of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_chunks(batch["text"], CHUNK):
                rows += [(len(s), *_fingerprint(s)) for s in shingle_sets(data, offsets, k)]
            n, a, b = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_key"], *(pa.array(x, pa.int64()) for x in (n, a, b))],
                ["doc_id", "row_key", "n", "fp", "fp2"],
            )

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, row_key long, n long, fp long, fp2 long")


def _dealt(hashes: np.ndarray, fps: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Rows ``bucket, hashes, holders`` of a flush, and direct counts as bucket -1.

    A shingle held by several classes of the flush is counted for them here; one posting without
    holder tells its bucket that it is shared, so a shingle of very many classes stays small.
    """
    order = np.lexsort((fps, hashes))
    hashes, fps = hashes[order], fps[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (fps[1:] != fps[:-1])
    hashes, fps = hashes[new], fps[new]
    heads = np.ones(len(hashes), bool)
    heads[1:] = hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(heads)
    sizes = np.diff(np.append(starts, len(hashes)))
    many = np.repeat(sizes > 1, sizes)
    holders, counts = np.unique(fps[many], return_counts=True)
    if len(holders):
        yield -1, counts.astype(np.int64).tobytes(), holders.tobytes(), len(holders)
    hashes, lone = hashes[starts], sizes == 1
    fps = fps[starts]
    bucket = (hashes % U64(buckets)).astype(np.int64)
    for part in (lone, ~lone):
        where = np.flatnonzero(part)
        where = where[np.argsort(bucket[where], kind="stable")]
        edges = np.searchsorted(bucket[where], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            own = where[edges[b] : edges[b + 1]]
            held = fps[own].tobytes() if part is lone else b""
            yield int(b), hashes[own].tobytes(), held, len(own)


def _shared_counts(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """``fp, shared``: at least how many first shingles of a class occur in other classes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            rows = list(_dealt(np.concatenate(held), np.concatenate(fps), buckets))
            names = ["bucket", "hashes", "holders"]
            columns = list(zip(*rows, strict=True))[:3] if rows else [[], [], []]
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch["text"], CHUNK):
                for values in shingle_sets(data, offsets, k):
                    fp = _fingerprint(values)[0]
                    if not len(values) or fp in seen:
                        continue
                    seen.add(fp)
                    part = values[: _first(len(values), percent)]
                    held.append(part)
                    fps.append(np.full(len(part), fp, np.int64))
                    total += len(part)
                    if total >= FLUSH:
                        yield flush()
                        held, fps, total = [], [], 0
                        seen.clear()
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, fps, alone = [], [], []
        for values, holders in zip(pdf["hashes"], pdf["holders"], strict=True):
            values = np.frombuffer(values, U64)
            hashes.append(values)
            alone.append(np.full(len(values), bool(holders)))
            fps.append(np.frombuffer(holders, np.int64) if holders else np.zeros(len(values), np.int64))
        hashes, fps, alone = (np.concatenate(x) for x in (hashes, fps, alone))
        order = np.lexsort((fps, alone, hashes))
        hashes, fps, alone = hashes[order], fps[order], alone[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (
            (hashes[1:] != hashes[:-1]) | (fps[1:] != fps[:-1]) | (alone[1:] != alone[:-1])
        )
        hashes, fps, alone = hashes[new], fps[new], alone[new]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        sizes = np.diff(np.append(starts, len(hashes)))
        known = np.repeat((sizes > 1) | ~alone[starts], sizes) & alone
        return ranged(*np.unique(fps[known], return_counts=True))

    def ranged(holders: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """Classes and their counts packed by range, one row for each range."""
        part = holders % buckets
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(buckets + 1))
        rows = []
        for r in np.flatnonzero(np.diff(edges)):
            own = order[edges[r] : edges[r + 1]]
            rows.append((int(r), holders[own].tobytes(), counts[own].astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["part", "holders", "counts"])

    def direct(pdf_batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdf_batches:
            for counts, holders in zip(pdf["hashes"], pdf["holders"], strict=True):
                yield ranged(np.frombuffer(holders, np.int64), np.frombuffer(counts, np.int64))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        holders = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["holders"]])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
        fps, back = np.unique(holders, return_inverse=True)
        return pd.DataFrame({"fp": fps, "shared": np.bincount(back, counts).astype(np.int64)})

    dealt = stored(docs.mapInArrow(deal, "bucket long, hashes binary, holders binary"), "postings")
    kind = "part long, holders binary, counts binary"
    met = dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(count, kind)
    at_once = dealt.where("bucket < 0").mapInPandas(direct, kind)
    return met.unionByName(at_once).groupBy("part").applyInPandas(add, "fp long, shared long")


def _filter_of(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of ``fp`` with two hashes, as ``FILTER_BITS`` bits in 32-bit words."""
    bits = F.lit(FILTER_BITS)
    places = F.array(F.pmod("fp", bits), F.pmod(F.shiftrightunsigned("fp", 32), bits))
    at = classes.select(F.explode(places).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at % 32 AS INT))")
    words = at.groupBy(F.expr("at div 32").alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[np.asarray(words["word"])] = np.asarray(words["set"]).astype(np.uint32)
    return out


def _passes(bits: np.ndarray, fp: int) -> bool:
    fp %= 1 << 64
    a, b = fp % FILTER_BITS, (fp >> 32) % FILTER_BITS
    return bool(bits[a >> 5] >> (a & 31) & 1) and bool(bits[b >> 5] >> (b & 31) & 1)


def _set_rows(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """``n, fp, hashes``: the set of each class that passes the filter, once for each class."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch["text"], CHUNK):
                rows = []
                for values in shingle_sets(data, offsets, k):
                    fp = _fingerprint(values)[0]
                    if len(values) and fp not in seen and _passes(shared.value, fp):
                        seen.add(fp)
                        rows.append((len(values), fp, values.tobytes()))
                n, fps, sets = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(sets, pa.binary())],
                    ["n", "fp", "hashes"],
                )

    return docs.mapInArrow(run, "n long, fp long, hashes binary").dropDuplicates(["fp"])


def _rare_shingles(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``h, fp``: the rarest shingles of each class that could have a partner at all."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(x, U64) for x in pdf["hashes"]])
        hashes, counts = np.unique(values, return_counts=True)
        bucket = (hashes % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            rows.append((int(b), int(pdf["batch"].iat[0]), hashes[own].tobytes(),
                         counts[own].astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "batch", "hashes", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, U64) for x in pdf["hashes"]]
        hashes, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
        total = np.bincount(back, counts, len(hashes)).astype(np.int64)
        rows, at = [], 0
        for batch, part in zip(pdf["batch"], parts, strict=True):
            own = total[back[at : at + len(part)]]
            at += len(part)
            known = own > 1
            if known.any():
                rows.append((int(batch), part[known].tobytes(), own[known].tobytes()))
        return pd.DataFrame(rows, columns=["batch", "hashes", "counts"])

    def offer(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        h, fp = [], []
        if len(pdf) and len(known):
            shared = np.concatenate([np.frombuffer(x, U64) for x in known["hashes"]])
            counts = np.concatenate([np.frombuffer(x, np.int64) for x in known["counts"]])
            order = np.argsort(shared)
            shared, counts = shared[order], counts[order]
            for own_fp, data in zip(pdf["fp"], pdf["hashes"], strict=True):
                values = np.frombuffer(data, U64)
                n = len(values)
                at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
                df = np.where(shared[at] == values, counts[at], 1)
                alone = int((df == 1).sum())
                least = least_overlap(n, percent)
                if n - alone < least:
                    continue
                rarest = np.lexsort((values, df))[alone : n - least + 1]
                h.append(values[rarest])
                fp.append(np.full(len(rarest), own_fp, np.int64))
        if not h:
            return pd.DataFrame({"h": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)})
        return pd.DataFrame({"h": np.concatenate(h).astype(np.int64), "fp": np.concatenate(fp)})

    by_batch = sets.select("batch", "fp", "hashes")
    asked = by_batch.groupBy("batch").applyInPandas(
        ask, "bucket long, batch long, hashes binary, counts binary"
    )
    answers = asked.groupBy("bucket").applyInPandas(answer, "batch long, hashes binary, counts binary")
    return (
        by_batch.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(offer, "h long, fp long")
    )


class Forest:
    """Union-find over places; the least place of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def divide_skip(
    lists: list[list[int]], least: int, mu: float = MU
) -> Iterator[tuple[int, int, list[list[int]]]]:
    """Members of enough lists: each with its count in the short lists, and the long lists.

    With the L longest lists set aside, a member of ``least`` lists is in at least ``least - L``
    of the others. These are merged through a heap.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(least - 1, int(least / (mu * np.log2(longest + 1) + 1)), len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for member, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count >= least - aside:
            yield member, count, long


def _in(values: list[int], x: int) -> bool:
    at = bisect_left(values, x)
    return at < len(values) and values[at] == x


def search(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets``, as pairs of places.

    With ``split``, only links between the sets before it and the others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    forest, out = Forest(n), []

    def link(i: int, j: int) -> None:
        if forest.root(i) != forest.root(j):
            forest.join(i, j)
            out.append((i, j))

    values, back, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.append(0, np.cumsum(sizes))
    if split is None:
        typical = int(np.argmax(np.add.reduceat(held[back], starts[:-1]) / sizes))
        mine = np.zeros(len(values), bool)
        mine[back[starts[typical] : starts[typical + 1]]] = True
        shared = np.add.reduceat(mine[back].astype(np.int64), starts[:-1])
        near = 100 * shared >= percent * (sizes + sizes[typical] - shared)
        for i in np.flatnonzero(near).tolist():
            link(typical, i)
        roots = np.array([forest.root(i) for i in range(n)])
        main = np.bincount(roots, minlength=n).argmax()
        asking = np.flatnonzero(roots != main).tolist()
        first, last = 0, n
    else:
        asking, first, last = list(range(split)), split, n
    if not asking:
        return out
    # The inverted lists of the places searched.
    part = slice(int(starts[first]), int(starts[last]))
    place = np.repeat(np.arange(first, last), sizes[first:last])
    order = np.argsort(back[part], kind="stable")
    members = place[order]
    edges = np.searchsorted(back[part][order], np.arange(len(values) + 1))
    for i in asking:
        least = least_overlap(int(sizes[i]), percent)
        own = back[starts[i] : starts[i + 1]]
        lists = [x for x in (members[edges[v] : edges[v + 1]].tolist() for v in own) if x != [i] and x]
        if len(lists) < least:
            continue
        for j, count, long in divide_skip(lists, least):
            if j == i or forest.root(i) == forest.root(j):
                continue
            a, b = int(sizes[i]), int(sizes[j])
            need = -(-percent * (a + b) // (100 + percent))
            rest = len(long)
            for one in long:
                if count >= need or count + rest < need:
                    break
                count += _in(one, j)
                rest -= 1
            if linked(count, a, b, percent) or count >= need:
                link(i, j)
    return out


def _searched(sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links found in each block pair of each neighbourhood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fps, data = None, {}, None

        def done() -> pd.DataFrame:
            places = sorted(fps, key=lambda x: (fps[x][0], x))
            halves = [fps[x][0] for x in places]
            split = None if key[1] == key[2] else halves.index(key[2]) if key[2] in halves else len(places)
            data = [np.frombuffer(fps[x][1], U64) for x in places]
            alone = split is not None and split in (0, len(places))
            found = [] if len(places) < 2 or alone else search(data, percent, split)
            return pd.DataFrame(
                [(places[i], places[j]) for i, j in found], columns=["u", "v"], dtype="int64"
            )

        for pdf in batches:
            for *now, fp, block, data in zip(
                pdf["near"], pdf["i"], pdf["j"], pdf["fp"], pdf["block"], pdf["hashes"], strict=True
            ):
                if key is not None and tuple(now) != key:
                    yield done()
                    fps = {}
                key = tuple(now)
                fps[fp] = (block, data)
        if key is not None:
            yield done()

    ordered = sets.repartition("near", "i", "j").sortWithinPartitions("near", "i", "j")
    return ordered.select("near", "i", "j", "fp", "block", "hashes").mapInPandas(run, "u long, v long")


def link_documents(
    docs: DataFrame, k: int = 4, percent: int = 85, keep_key: bool = False
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, one row per input row.

    Words are runs of anything but ASCII white space, A-Z as a-z; a document's set has the shingles
    of ``k`` words, or all its words as one. Two documents link when their sets' similarity is at
    least ``percent`` hundredths; a component is named by its least ``doc_id``. Documents without
    words, null texts among them, have no shingles and their own ``doc_id``. Repeated rows link
    with each other. Shingles are told apart by 64-bit hashes. Other columns are not read.
    ``keep_key`` adds ``row_key``, a hash of the row's id and text.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_classes(read, k), "classes")
    classes = rows.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep"))
    first = F.expr(f"n - ceil({percent} * n / 100) + greatest(1, n div 10)")
    total = rows.agg(F.sum(first).alias("first")).first()["first"] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    counts = _shared_counts(read, k, percent, buckets)
    enough = F.expr(f"shared >= greatest(1, CAST(ceil({percent} * n / 100) AS BIGINT) div 10)")
    left = stored(classes.join(counts, "fp").where(enough), "left")

    total = left.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    # What passes the filter by chance has no partner; it costs time, never a result.
    sets = _set_rows(read, k, _filter_of(left))
    sets = stored(sets.withColumn("batch", F.pmod(F.xxhash64("fp"), F.lit(buckets))), "sets")
    rare = stored(_rare_shingles(sets, percent, buckets), "rare")
    least = rare.groupBy("h").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most")
    ties = rare.join(least, "h").select(F.col("fp").alias("u"), "v").distinct()
    near = components(ties).select(F.col("node").alias("fp"), F.col("component").alias("near"))

    sizes = sets.select("fp", "n").join(near, "fp").groupBy("near").agg(F.sum("n").alias("total"))
    sizes = sizes.select("near", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    placed = sets.select("fp", "hashes").join(near.join(sizes, "near"), "fp")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "fp"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = placed.select("near", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                          "fp", "block", "hashes")
    found = components(_searched(pairs, percent))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_component = named.select("fp", "fp2", "n", "component").join(lowest, "component")
    of_class = classes.join(of_component.drop("component"), ["fp", "fp2", "n"], "left").select(
        "fp", "fp2", "n", F.coalesce("component_id", "rep").alias("component_id")
    )
    return rows.join(of_class, ["fp", "fp2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *(["row_key"] if keep_key else []),
    )
