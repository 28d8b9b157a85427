from __future__ import annotations

import pytest

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, short and very long texts, repeats, ties, and columns named like the operators' own."""
    texts = [None, "", "  \n\t ", "one", "one two three four", LONG, "Same text, twice over and over again.", "Same text, twice over and over again.", "日本語のテキスト é́ 👩‍👩‍👧 naïve İ", "tab\tsep  double  \n\n blank lines \x1c x", "<|endoftext|> special <|ENDOFTEXT|>"]
    rows = [(k, t, None if k % 3 == 0 else "en", "src", 0, "clash", 1, 2, 3, "x", None) for k, t in enumerate(texts)]
    rows.append((7, "a repeated id", "de", None, 0, "clash", 1, 2, 3, "x", None))
    rows.append((None, "no id here", "de", None, 0, "clash", 1, 2, 3, "x", None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n int, start int, length int, spans string, ids binary")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
