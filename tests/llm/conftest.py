"""A small corpus with copies, near copies, shared passages, nulls and blanks."""

from __future__ import annotations

import random

import pytest
from samples import SCHEMA, sentence


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars)."""
    pick = random.Random(11)
    texts = [sentence(pick, pick.choice([0, 1, 2, 5, 12, 13, 14, 40, 120])) for _ in range(60)]
    shared = sentence(pick, 30)
    texts += [f"{sentence(pick, 20)} {shared}  {sentence(pick, 9)}" for _ in range(12)]
    base = sentence(pick, 300).split()
    texts += [" ".join(base)] * 6
    for k in range(12):
        near = list(base)
        near[20 * k] = "other"
        texts.append(" ".join(near))
    texts += ["", None, " \t\n ", "\x1cword \x85 é x", "word " * 4000, "UPPER lower\x0bÉtat"]
    return [(i, t, "en", [None, "a", "b", "c"][i % 7 % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
