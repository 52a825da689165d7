from __future__ import annotations

import pytest

from cohortspark.storage import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def scratch(spark):
    made = Scratch(spark)
    yield made
    made.close()


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
