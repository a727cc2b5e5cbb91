"""Token counts by the whole-token shortcut.

A piece vocabulary marks word starts. No piece has a start mark after another character, so no
merge crosses from one word into the next one's mark, and a text's count is the sum over its words.
Which words are one token by themselves is proved before any text is read: each vocabulary string
is encoded alone. Such words count one by a look-up; the others are merged by the library and the
most recent answers kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"

#: Words merged by the library that a worker remembers, besides the proved ones.
REMEMBERED = 300_000
#: Longer words are not remembered.
LONGEST = 64

_SPACED = re.compile(" *[^ ]+| +")


def proved_words(model) -> dict[str, int] | None:
    """Words that are one token with their mark; None if a piece could span two words."""
    alone = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        word = piece.lstrip(MARK)
        if MARK in word:
            return None
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        if special or piece != MARK + word or not word:
            continue
        if model.encode(word) == [i]:
            alone[word] = 1
    return alone


class WordCounts(dict):
    """Tokens of a word that follows one space: proved words at once, others by the library."""

    def __init__(self, model) -> None:
        self.proved = proved_words(model)
        self.model = model
        super().__init__(self.proved or {})

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))
        if len(word) <= LONGEST:
            if len(self) >= len(self.proved) + REMEMBERED:
                self.clear()
                self.update(self.proved)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.proved is None:
            return len(self.model.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            found = [x[1:] for x in _SPACED.findall(" " + text)]
            # A lone space is a mark with nothing after it.
            return sum(self[x] if x else 1 for x in found)
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def _counts(path: str) -> WordCounts:
    import sentencepiece

    return WordCounts(sentencepiece.SentencePieceProcessor(model_file=path))


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row per input row.

    A null text is empty and has no tokens; repeated rows give repeated results; other columns
    are not read. ``model_path`` is a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(model_path)
        for batch in batches:
            n_tokens = [counts.count(x or "") for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
