import pytest

#: Null and empty texts, white space alone, repeats, one very long text, non-ASCII, markup-like and escape-like text.
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8,
    "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8,
    "Été à la plage — 東京\x00\x0b naïve <b>x</b> &amp; don't 123,456 <|endoftext|>",
    "line\nline\nother line\nline\n",
    "#### $$$ %%% &&& ***",
    "word " * 30000,
    "a" * 5000,
    "the quick brown fox jumps over the lazy dog. " * 20,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in any column, repeated rows, and extra columns with names that operators use."""
    rows = [(k, t, f"s{k % 3}" if k % 5 else None, "en", k, "x") for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "lost and found in the middle of nowhere at all", "s1", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words long, feature string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
