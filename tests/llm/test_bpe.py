"""Merges by segment trees against the vocabulary's own library."""

import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cartulary.llm import bpe
from tests.llm.conftest import hostile_texts
from tests.llm.test_tokens import random_texts

RANKS = public.path("byte_bpe_50k.tiktoken")
OWN = bpe.Encoder(RANKS, public.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


def own_ids(text):
    return np.frombuffer(OWN.ids([text])[0], "<i4").tolist()


def plain(piece, ranks):
    """The leftmost pair of least rank again and again, over all pairs each time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert own_ids(text) == LIBRARY.encode_ordinary(text)
    assert OWN.decode(own_ids(text)) == text.encode()


def test_ids_are_those_of_the_library():
    texts = random_texts(4000)
    got = OWN.ids(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == LIBRARY.encode_ordinary(text), text


def test_both_trees_merge_alike():
    r = random.Random(2)
    ranks = OWN.ranks
    for width in bpe.Trees.WIDTHS:
        some = [bytes(r.choices(b"abcdefgh th\xc3\xa9", k=r.randint(1, width))) for _ in range(500)]
        some += [b"a" * width, b"the" * (width // 3), b"ab" * (width // 2)]
        some = [x for x in some if x not in ranks]
        for piece, ids in zip(some, OWN.trees.merged(some, width), strict=True):
            want = plain(piece, ranks)
            assert np.frombuffer(ids, "<i4").tolist() == want == bpe.merged(piece, ranks)


@pytest.mark.parametrize("text", ["x" * 50_000, " " * 20_001, "日本語" * 9000, "!" * 30_000, "abcab" * 9000])
def test_long_pre_tokens(text):
    assert own_ids(text) == LIBRARY.encode_ordinary(text)


def test_long_texts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 1000)
    monkeypatch.setattr(bpe, "PIECES", 7)
    text = " ".join(random_texts(900))
    assert len(text) > 1000 and own_ids(text) == LIBRARY.encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(RANKS, public.PATTERN)
    for text in random_texts(50):
        assert np.frombuffer(own.ids([text])[0], "<i4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(own.known) <= 3


def test_hostile_documents(hostile, nothing):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    decoded = bpe.decode(bpe.encode(hostile, RANKS, public.PATTERN), RANKS, public.PATTERN)
    got = sorted(map(tuple, bpe.digests(decoded).fillna(-1, ["doc_id"]).collect()))
    want = []
    for i, text in hostile_texts():
        ids = LIBRARY.encode_ordinary(text or "")
        digest = sha(" ".join(map(str, ids)).encode())
        want.append((-1 if i is None else i, len(ids), digest, sha((text or "").encode())))
    assert got == sorted(want)
    assert bpe.digests(bpe.decode(bpe.encode(nothing, RANKS, public.PATTERN), RANKS, public.PATTERN)).collect() == []
