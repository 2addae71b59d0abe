"""Helpers for the numbered operators."""

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, size long, id long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with extra columns
    whose names operators use inside."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), 7, 9) for r in rows]
        return spark.createDataFrame(full, WIDE).repartition(parts)

    return make
