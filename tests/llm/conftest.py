from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, node long, size string, key string"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak tree near the river"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with names the operators use inside."""
    rows = [
        (1, PLAIN, "en", "b"),
        (2, PLAIN.upper(), "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", "a"),
        (None, "no id at all here", "en", "a"),
        (None, None, None, None),
        (7, PLAIN, "en", "b"),
        (7, PLAIN, "en", "b"),
        (8, "word " * 40_000, "en", "c"),
        (9, "x" * 200_000, "en", "c"),
        (10, "ÄÖ É 中文 \U0001f600 é", "de", "ä"),
        (11, "äö É 中文 \U0001f600 é", "de", "ä"),
        (12, "one two three", "en", "a"),
        (13, "One  Two\nthree", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "r", 5, "s", "k") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
