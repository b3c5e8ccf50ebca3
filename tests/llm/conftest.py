import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """rows -> a documents table with a column that clashes with names the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kid string")

    return make
