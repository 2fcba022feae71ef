"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, block long, k int, copy int, h string, ids string"


def rows(texts):
    return [(i, t, "en", "s", 0, "p", 1, 2, 3, "h", "x") for i, t in texts]


def passage(seed: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    a, b, c = passage(1), passage(2), passage(3, 400)
    edited = " ".join(w if n != 30 else "changed" for n, w in enumerate(a.split()))
    return [
        (5, a), (3, a), (9, edited), (4, None), (7, ""), (11, "   \n\t "), (12, "One two"), (13, "one  TWO"), (14, f"{b} {a[:80]}"), (15, b), (15, b), (None, b), (16, c + " " + c), (2, c),
        (20, "x" * 3000), (21, "x" * 120), (22, "<|endoftext|> mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 call +49 (30) 1234567"), (23, "loser scum idiot " + passage(9, 30)), (24, "ß\u0130 \U0001F600 e\u0301 \x1c\x85 3½"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
