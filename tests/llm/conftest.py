import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns whose names the operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "b", 0, "y"),
        (None, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 5, "z"),
        (None, None, None, None, None, None),
        (4, "wort " * 30_000, "de", "b", 150_000, "y"),
        (5, "\n\n \t\n", "en", "b", 5, "y"),
        (6, "12345 !!! \u20ac \U0001f600", None, "b", 5, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
