import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, with ids from 0."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
