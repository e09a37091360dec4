"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, block long, score double, kept boolean"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(rng.choice(("th", "er", "on", "ti", "ing", "ed")) for _ in range(1 + rng.randrange(vocabulary) % 3))
        out.append(w.capitalize() + "." if i % 12 == 11 else w)
        if i % 30 == 29:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def near(text: str, at: int) -> str:
    words = text.split(" ")
    words[at % len(words)] = "changed"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    base, long = prose(1, 200), prose(2, 6000)
    line = "A line that very many documents share, word for word."
    rows = [
        (1, base), (2, base), (3, near(base, 50)), (4, near(base, 150)), (5, ""), (6, None), (7, "   \n\t"), (8, "one two"), (9, "one two"), (10, long),
        (11, prose(3, 120) + "\n" + line), (12, prose(4, 120) + "\n  " + line.upper() + " "), (13, prose(5, 90) + "\n" + line + "\n" + line), (14, line),
        (15, "É" + prose(6, 60) + " naïve x"), (16, "x" * 5000), (17, "zero\0byte here"), (None, prose(7, 80)), (None, prose(7, 80)), (18, prose(8, 70)), (18, prose(8, 70)),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if k % 7 == 3 else ("en", "de")[k % 2], f"src{k % 3}", None, "clash", 7, 0.5, True) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
