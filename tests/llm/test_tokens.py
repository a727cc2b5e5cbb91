"""Packing and token counts against the libraries, sharding against a plain schedule."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cartulary.llm import packing, sharding, tokens
from tests.llm.conftest import hostile_texts

JSON = public.path("byte_bpe_50k.json")
RANKS = public.path("byte_bpe_50k.tiktoken")
PIECES = public.path("piece_bpe_32k.model")

PARTS = [" ", "  ", "\n", "\n\n", "a", " the", "'s", "'ll", "é", "É", "ª", "²", "½", "日本", "\t", "▁",
         "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "　", "\xa0", "😀", "\x00", "\x1c", "\x85",
         "12", "!!", "ǅ", "\r\n", "ing", "ﬁ"]


def random_texts(n):
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    own, library = packing.ByteLevelIds(JSON, RANKS), Tokenizer.from_file(JSON)
    for text in random_texts(4000):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == np.array(want, "<u4").tobytes(), text


def test_counts_are_those_of_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = tokens.WordCounts(model)
    assert len(counts.proved) > 10_000
    for text in random_texts(4000):
        assert counts.count(text) == len(model.encode(text)), text


def test_count_of_hostile_documents(hostile, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_bytes, r.over_limit)
                 for r in tokens.count_tokens(hostile, PIECES, 4096).collect())
    want = []
    for i, t in hostile_texts():
        n = len(model.encode(t or ""))
        want.append((i or -1, n, len((t or "").encode()), n > 4096))
    assert got == sorted(want)
    assert tokens.count_tokens(nothing, PIECES, 4096).collect() == []


def test_pieces_of_hostile_documents(hostile, nothing):
    own = packing.ByteLevelIds(JSON, RANKS)
    rows = packing.pack(hostile, JSON, RANKS).collect()
    want = defaultdict(int)
    for i, t in hostile_texts():
        ids = own.ids(t or "") + bytes(4)
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    for r in rows:
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    assert not any(want.values())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.length <= r.tier
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing, JSON, RANKS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(nothing, JSON, RANKS, tiers=(100, 1024))


def test_little_padding_and_even_steps():
    r = random.Random(5)
    lengths = [r.randint(1, 1024) for _ in range(5000)]
    packed = packing.pack_lengths(lengths, packing.TIERS)
    assert sorted(i for s in packed for i in s) == list(range(5000))
    used = [sum(lengths[i] for i in s) for s in packed]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert max(used) <= 1024 and padding < 0.01 * sum(used)
    costs = np.array([sum(lengths[i] ** 2 for i in s) for s in packed], float)
    steps = packing.step_groups(costs, 64)
    assert np.bincount(steps).max() <= 64
    means = np.bincount(steps, costs) / np.bincount(steps)
    assert means.max() < 1.02 * means.min()


def test_tiers_are_packed_from_the_longest_down():
    # 1023 and 1000 open windows; 24 and 20 fill the gap of 1000, the rest of the short tier shares one.
    lengths = [24, 1000, 1, 1023, 128, 20, 500, 70, 512]
    packed = packing.pack_lengths(lengths, packing.TIERS)
    assert packed == [[4], [8], [3, 2], [1, 0], [6, 7, 5]]
    r = random.Random(6)
    lengths = [r.choice([r.randint(1, 127), r.randint(1, 1024)]) for _ in range(2000)]
    for sequence in packing.pack_lengths(lengths, packing.TIERS):
        tiers = [packing.tier_of(lengths[i], packing.TIERS) for i in sequence]
        assert tiers[0] == max(tiers)


def test_schedule_is_longest_first():
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {
        "a": 0, "b": 1, "c": 1, "d": 0,
    }


def test_shards_of_hostile_documents(hostile, nothing):
    rows = sharding.shard_documents(hostile, 4).collect()
    assert len(rows) == len(hostile_texts())
    texts = defaultdict(set)
    sizes = {i: len((t or "").encode()) + (0 if t is None else 0) + 1 for i, t in hostile_texts()}
    for r in rows:
        if r.doc_id is not None:
            assert r.size == sizes[r.doc_id]
        texts[r.text_crc32, r.size].add(r.shard)
    # A null text and an empty one are two groups with the same digest.
    assert all(len(s) == 1 for k, s in texts.items() if k[1] > 1)
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(nothing, 4).collect() == []


def test_small_groups_travel_in_bundles(spark):
    rows = spark.range(20_000).selectExpr("CAST(id % 9000 AS STRING) AS key", "1 + id % 7 AS size")
    placed = sharding.place_groups(rows, "key", "size", 16, fineness=4)
    assert placed.groupBy("key").agg({"shard": "approx_count_distinct"}).where(
        "`approx_count_distinct(shard)` > 1"
    ).isEmpty()
    loads = [r[0] for r in placed.groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(loads) == 16 and max(loads) < 1.01 * min(loads)
