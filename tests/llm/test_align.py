"""Alignment of two tokenizers against the libraries and a plain walk."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartulary.llm import align
from tests.llm.conftest import SCHEMA, hostile_texts
from tests.llm.test_tokens import random_texts

PATHS = [public.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
# The alphabet that byte-level vocabularies write bytes in.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(x): x for x in SHOWN} | {
    chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in SHOWN)
}


def plain_tokens(text):
    """Ids and bytes of A and B by the libraries, or none."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    return a, b


def plain_groups(a, b):
    out, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        while sum(len(x) for _, x in left) != sum(len(x) for _, x in right):
            if sum(len(x) for _, x in left) < sum(len(x) for _, x in right):
                left.append(a[i + len(left)])
            else:
                right.append(b[j + len(right)])
        out.append(([x for x, _ in left], [x for x, _ in right]))
        i, j = i + len(left), j + len(right)
    return out


def plain_rows(texts):
    found = [(i, *plain_tokens(t)) for i, t in texts]
    groups = [plain_groups(a, b) for _, a, b in found]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(pair for of in links for pair in of)
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(highest.get(x, 0), n)
    rows = []
    for (i, a, b), g, of in zip(found, groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in of.items() if held[p] == highest[p[0]])
        total = sum(n * held[p] for p, n in of.items())
        rows.append((-1 if i is None else i, len(a), len(b), len(g), sum(of.values()), shown, best, total))
    return sorted(rows)


def rows_of(docs, **options):
    scored = align.with_pair_counts(align.align(docs, *PATHS), **options)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    return sorted(map(tuple, scored.select(*names).fillna(-1, ["doc_id"]).collect()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60, unique=True), st.lists(st.integers(1, 40), max_size=60, unique=True))
def test_irregular_groups(a, b):
    ends_a, ends_b = (np.array(sorted({*x, 41}), np.int32) for x in (a, b))
    odd = align.irregular_groups(ends_a, ends_b)
    both = np.intersect1d(ends_a, ends_b)
    want = []
    for before, end in zip([0, *both], both, strict=False):
        at = [int(np.searchsorted(e, x, "right")) for e in (ends_a, ends_b) for x in (before, end)]
        if at[1] - at[0] > 1 or at[3] - at[2] > 1:
            want.append(at)
    assert odd.tolist() == want


def test_no_tokens():
    none = np.zeros(0, np.int32)
    assert len(align.irregular_groups(none, none)) == 0


def test_pieces_are_those_of_the_library():
    own = align.PieceIds(PATHS[2])
    for text in random_texts(3000):
        assert np.frombuffer(own.ids(text), "<i4").tolist() == B.encode(text), text


def test_random_texts(spark):
    texts = list(enumerate(random_texts(600)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in texts], SCHEMA).repartition(3)
    want = plain_rows(texts)
    assert rows_of(docs) == want
    # Few pairs, or none, by broadcast, the others by the shuffle.
    assert rows_of(docs, hot_pairs=20) == want
    assert rows_of(docs, hot_pairs=0) == want


def test_hostile_documents(hostile, nothing):
    assert rows_of(hostile) == plain_rows(hostile_texts())
    assert rows_of(nothing) == []


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdé ,\n", k=r.randint(1, 9))) for _ in range(3000))
    monkeypatch.setattr(align, "TOGETHER", 700)
    aligner = align.Aligner(*PATHS)
    parts = aligner.parts(text)
    assert len(parts) > 10 and " ".join(parts) == text
    doc = align._Document(1)
    for at in range(0, len(parts), 2):
        aligner.add([(doc, x) for x in parts[at : at + 2]])
    a, b = plain_tokens(text)
    groups = plain_groups(a, b)
    row = doc.row()
    assert row[1:5] == (len(a), len(b), len(groups), sum(len(x) * len(y) for x, y in groups))
    assert row[5] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    links = Counter((x, y) for p, q in groups for x in p for y in q)
    assert dict(zip(zip(row[6].tolist(), row[7].tolist(), strict=True), row[8].tolist(), strict=True)) == links


def test_a_part_that_is_not_given_back_empties_the_document():
    aligner = align.Aligner(*PATHS)
    doc, other = align._Document(1), align._Document(2)
    aligner.add([(doc, "one two"), (other, "three"), (doc, "a▁b")])
    assert not doc.exact and doc.row()[1:6] == (0, 0, 0, 0, "")
    assert other.row()[1] == 1


def test_large_groups_are_counted_by_distinct_pairs(monkeypatch):
    aligner = align.Aligner(*PATHS)
    texts = ["日本語" * 20 + " the end", " " * 300 + "x"]
    whole = []
    for limit in (10**9, 0):
        monkeypatch.setattr(align, "SMALL_GROUP", limit)
        docs = [align._Document(k) for k in range(2)]
        aligner.add(list(zip(docs, texts, strict=True)))
        whole.append([[np.asarray(x).tolist() for x in doc.row()] for doc in docs])
    assert whole[0] == whole[1]
