import pytest

#: Rows for every kind of trouble: null, empty, blank, ties, repeats, non-ASCII, one very long text.
WORDS = [f"word{i % 97}x{i // 97}" for i in range(4000)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = " ".join(WORDS)
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "  \n \t ", "en", "s", 0), (4, "same words here now", "en", "s", 0), (5, "same words here now", "en", "s", 0), (5, "same words here now", "en", "s", 0)]
    rows += [(6, long_text, "en", None, 1), (7, long_text + " tail", None, "s", 1), (8, "é日本 😀\x01\x00", "fr", "s", 2), (None, "no id", "en", "s", 3), (9, "one", "de", "s", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
