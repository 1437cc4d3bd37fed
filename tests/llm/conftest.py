import pytest


@pytest.fixture(scope="session")
def shape(spark):
    """A documents-like table from (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")

    return make
