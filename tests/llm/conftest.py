from __future__ import annotations

import random

import pytest

WORDS = "the of and zone river ember tolan merit quilt harbor sonder plinth vexed ochre lumen".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, words int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choices("abcdeiklmnorstu", k=r.randint(2, 7))) for _ in range(n)]
    return " ".join(r.choice([w, r.choice(WORDS)]) for w in made)


def hostile_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = prose(1, 30_000)
    texts: list[tuple[int | None, str | None]] = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, "ONE two three"),
        (6, long), (7, long + " tail"), (None, prose(2, 50)), (None, None), (8, "é ñ ß 日本 😀"),
        (9, "x" * 50_000), (1 << 60, prose(3, 40)),
    ]
    texts += [(20, prose(4, 60))] * 3
    texts += [(i, prose(5, 80)) for i in range(30, 36)]
    for i in range(40, 60):
        words = prose(6, 120).split()
        words[i % 40] = "edited"
        texts.append((i, " ".join(words)))
    return texts


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with extra columns whose names clash with results and working columns."""
    rows = [(i, t, "en", "s", 0, 1, "x", 2) for i, t in hostile_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
