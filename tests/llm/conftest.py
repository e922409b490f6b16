"""Documents with every awkward case, and plain answers computed in Python."""

from __future__ import annotations

import pytest

DOCS = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
    "_k1 LONG, _row STRING, _text STRING, _id LONG, size INT, kept STRING, n_words STRING"
)

LINES = [f"line number {word} of a text that goes on" for word in "one two three four five".split()]


def awkward_rows():
    whole = "\n".join(LINES)
    long_text = " ".join(f"word{i % 5003}." for i in range(30_000))
    texts = [
        (1, whole, "a"),
        (1, whole, "a"),  # a repeated row
        (1, "same id, other text", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, " \n\t \n", "b"),
        (5, whole + "\n\nand more words after it", None),
        (6, "no line break at all, just words, words and words", "b"),
        (7, long_text, "b"),
        (8, long_text, "c"),
        (9, "Été 中文 \U0001f600 x \\ <|end|> </s> [INST]", "c"),
        (None, "a document without an id has words too", "c"),
        (None, None, None),
        (10, "MIT License. Licensed under CC BY-NC 4.0. cc by cc by", "c"),
    ]
    return [
        (i, t, None if i == 2 else "en", s, None if t is None else len(t), 1, "r", "t", 2, 3, "k", "w")
        for i, t, s in texts
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """(doc_id, text, source) of the smallest table."""
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in documents.collect()]
