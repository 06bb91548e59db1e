import pytest


@pytest.fixture(scope="session")
def docs_edge(spark):
    """Nulls, empty and very long texts, copies, ties, and columns whose names clash with results."""
    long = "Wörter und the words 12 again. " * 9000
    texts = [None, "", " ", "one", "a b c", "a b c", "A  B\tc ", long, long, "call +1 (555) 123-4567 or x.y@example.com", "<|endoftext|> in text", "one two three four five six seven"]
    rows = [(i, t, 7, "ids", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, fingerprint string, lang string")
