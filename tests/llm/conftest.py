from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of the documents table from texts; ids count from 0 unless rows are given whole."""

    def make(*texts, extra: str = "", values: tuple = ()):
        rows = [t if isinstance(t, tuple) else (i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame([r + values for r in rows], DOCUMENTS + (f", {extra}" if extra else ""))

    return make
