import pytest


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text) pairs, with the columns that the table has and one whose name clashes."""

    def make(*rows, source=lambda i: "a" if (i or 0) % 2 else None):
        full = [(i, t, "en", source(i), len(t or ""), 1.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make
