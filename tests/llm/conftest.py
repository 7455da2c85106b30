import pytest

#: Texts that every operator must take: null, empty, blank, marks only, one word, repeated rows, a very long text.
ODD_TEXTS = [None, "", "   \n\t", "!!! ???", "word", "word", "Ünï 漢字 😀", "long " * 30_000 + "end", "a\n\nb\r\n", "x" * 50_000]


@pytest.fixture
def odd(spark):
    """Odd texts with null ids, a repeated id, and columns whose names clash with those that operators make."""
    rows = [(None if i == 3 else (4 if i == 5 else i), t, None, f"s{i % 2}" if i else None, i, "c", 1.0) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, `key` string, size double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
