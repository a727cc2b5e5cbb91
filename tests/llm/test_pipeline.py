"""Each stage of the pipeline, and all of them, against plain versions on a small corpus."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cartulary.llm import secrets
from tests.llm.conftest import prose
from tests.llm.test_links import brute_components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, words int, fp string"
ITEMS = [(i, prose(700 + i, 24)) for i in range(4)]
SECRET = 'password = "Zk81mQx07Lw2TtV9"'


def corpus():
    """Good documents, symbol-ridden ones, near copies, benchmark passages, a secret, odd rows."""
    texts = {i: prose(100 + i, 60 + i) for i in range(60)}
    bad = {i: prose(i, 60).replace("e", "#").replace("a", "#") for i in range(200, 240)}
    for i in range(60, 66):
        words = prose(100, 60).split()
        words[i - 30] = "edited"
        texts[i] = " ".join(words)
    for i, item in ITEMS:
        texts[70 + i] = f"{prose(300 + i, 40)} {item} {prose(400 + i, 40)}"
    texts[80] = f"{prose(500, 40)} {SECRET} {prose(501, 40)}"
    rows = [*texts.items(), *bad.items(), (81, None), (82, ""), (83, prose(9, 20_000))]
    rows += [(84, prose(10, 50))] * 3 + [(None, prose(11, 50))]
    return rows, {*texts, 83, 84, None}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, good = corpus()
    full = [(i, t, "en", "hot", len(t or ""), 1, "x") for i, t in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i in good), 0) for i, _ in rows if i is not None and i not in (81, 82)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def survivors(rows):
    """One row of each group: brute-force components at five words and 0.8, the least id stays."""
    distinct = sorted(set(rows), key=str)
    lowest = {d: c for d, n, c in brute_components(distinct, 5, 80) if n}
    return [(i, t) for i, t in distinct if i is None or lowest.get(i, i) == i]


def test_stages_and_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows, good = corpus()

    quality = pipeline.drop_low_quality(spark, docs, tables)
    assert quality.columns == list(pipeline.COLUMNS)
    want = [(i, t) for i, t in rows if i in good]
    assert pairs(quality) == sorted(want, key=str)

    single = pipeline.drop_near_duplicates(spark, quality, tables)
    assert single.columns == list(pipeline.COLUMNS)
    want = survivors(want)
    assert not {i for i, _ in want} & set(range(60, 66))
    assert pairs(single) == sorted(want, key=str)

    clean = pipeline.drop_contaminated(spark, single, tables)
    assert clean.columns == list(pipeline.COLUMNS)
    want = [(i, t) for i, t in want if i is None or not 70 <= i < 74]
    assert pairs(clean) == sorted(want, key=str)

    masked = pipeline.mask_secrets(spark, clean, tables)
    assert masked.columns == list(pipeline.COLUMNS)
    spans = lambda t: (b := secrets.base_spans(t)) + secrets.novel_spans(t, b)
    want = [(i, secrets.masked(t, spans(t), pipeline.MASK)) for i, t in want]
    assert pairs(masked) == sorted(want, key=str)
    hidden = dict(want)[80]
    assert pipeline.MASK in hidden and "Zk81mQx07Lw2TtV9" not in hidden
    assert {r.doc_id: r.n_chars for r in masked.collect()} == {i: len(t) for i, t in want}

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    held = defaultdict(list)
    for r in pipeline.run(spark, tables).collect():
        held[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(held) == {i for i, _ in want}
    for doc_id, text in want:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, n in sorted(held[doc_id]):
            assert (start, n, crc) == (at, len(ids), zlib.crc32(ids[start : start + length].tobytes()))
            at += length
        assert at == len(ids)


def test_stages_of_nothing(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, tables).collect() == []
