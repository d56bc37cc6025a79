import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string"


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = "The quick brown fox jumps over the lazy dog, again. " * 3000
    rows = [
        (1, "a b c d e", "en", "s1", 9, "x", "y"),
        (2, "a b c d e", "en", None, 9, "x", "y"),
        (2, "a b c d e", "en", None, 9, "x", "y"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "s1", 0, None, None),
        (5, " \t\n", "en", "s2", 3, None, None),
        (6, long, "en", "s2", len(long), None, None),
        (7, "x" * 70_000, "en", "s2", 70_000, None, None),
        (8, "é ß 日本語 <|endoftext|> \u0000 ퟿", "de", "s3", 20, None, None),
        (None, "a b c d e", "en", "s1", 9, None, None),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)
