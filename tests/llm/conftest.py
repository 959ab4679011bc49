from __future__ import annotations

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row string, digest string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from ``(id, text)`` or ``(id, text, lang, source)``, with columns whose names operators use inside."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", "y", None) for i, t, lang, source in full], DOCUMENT)

    return build


@pytest.fixture(scope="session")
def real(spark):
    """Every document of the small table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Nulls, empty and blank texts, ties and repeats.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b", "en", None), (4, "one two three", "en", "a"), (4, "one two three", "en", "a"),
    (None, "one two three", None, "b"), (None, None, None, None), (5, "ONE  two\nthree", "fr", "b"), (6, "é è 12 😀", "fr", ""),
]
