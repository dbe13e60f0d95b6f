"""Small fixtures shared by the tests of the numbered operators."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, kept string, spans string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of given (doc_id, text), with columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, None, "s", None if t is None else len(t), 7, "x", "y") for i, t in rows], SCHEMA)
    return make
