import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with the other columns and one more."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make
