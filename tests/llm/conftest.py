import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a DataFrame with extra columns whose names clash with those of results."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    prose = " ".join(f"word{i} and more of it" for i in range(60))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, prose, "en", "a", 1), (4, prose, "fr", "b", 1), (4, prose, "fr", "b", 1), (None, "x y z", "en", "a", 5),
        (5, "one", "de", "a", 3), (6, "a  b\n\n\tc \u00a0 \u00e9\u4e2d\U0001f642 don't", "en", "a", 1), (7, "line one here\n" * 40, "en", "a", 1), (8, "z" * 300_000, "en", "a", 1),
        (9, " ".join(f"w{i % 997}" for i in range(60_000)), "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
