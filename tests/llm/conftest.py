from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a table of documents, with extra columns whose names the operators use too."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, -1, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
