"""Small tables with every odd case, for all operators."""

from __future__ import annotations

import pytest

from tests.llm.brute import WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id long, _rk long, spans string, score double, label string, features string, weight double, tokens long, shard string, slot string, fp long, ids string, kept string, words string"
PASSAGE = " ".join(WORDS[(7 * i) % len(WORDS)] + str(i % 13) for i in range(70))
OTHER = " ".join(WORDS[(11 * i + 3) % len(WORDS)] for i in range(90))
LONG = " ".join(f"{WORDS[i % len(WORDS)]}{i}" for i in range(60_000))
UNBROKEN = "acgt" * 500_000
TEXTS = [
    UNBROKEN,
    None, "", " \t\n\x0b", "one", "one two", OTHER, OTHER, OTHER + " end", PASSAGE, "before the passage " + PASSAGE + " after it", "x" * 450, "y" + "x" * 300,
    LONG, LONG[:500_000] + " tail", "Ünï cödé ﷽ 漢字 🙂🙂 'll don't    space wide\x85next " + "é" * 150, "same line\nsame line\n\n same line\nother | $ # & %",
    "A B C a b c A B C a b c A B C a b c A B C a b c A B C a b c", PASSAGE + " " + PASSAGE, "YOU stupid idi0t!!! loooooser you", "\U0010ffff\x00 nul",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, a repeated row, a null id, and columns named like the operators' own."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["web", "web", None, "books"][i % 4], len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a text without an id", None, None, None)]
    clash = ("r", 1, 2, "s", 0.5, "l", "f", 1.0, 7, "sh", "sl", 3, "i", "k", "w")
    return spark.createDataFrame([r + clash for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
