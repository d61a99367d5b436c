import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string, fp string, keep_id string, score string, items string"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns that bear the names of results; nulls where nothing is given."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None, i, "x", None, "y", None, "z") for i, t in rows], DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Null id, null and empty texts, white space, repeated rows, a very long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (None, "null id"), (4, "twice"), (4, "twice"), (5, "word " * 30000), (6, "é" * 900), (None, None)]
