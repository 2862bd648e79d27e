"""The session and small tables of the tests of this folder."""

import pytest

LONG = ("Long words go on and on, line after line, until nobody reads them. " * 2400).strip()


def documents(spark, rows, extra=False):
    """doc_id, text, lang, source rows as the table documents; ``extra``: further columns with clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        for name in ("size", "key", "k", "d", "n", "p", "root", "rate", "text_sha256", "h"):
            df = df.selectExpr("*", f"'{name}' AS `{name}`")
        df = df.selectExpr("*", "map('a', 1) AS `odd.name`")
    return df


#: Nulls in every column, empty and blank texts, repeats, ties, a very long text.
ODD = [
    (1, "one two three four", "en", "a"), (2, "one two three four", "en", "a"), (3, None, "en", "a"), (4, "", None, None),
    (5, " \t\n", "de", "b"), (None, "one two three four", None, "b"), (None, None, None, None), (7, "x", "de", "c"),
    (7, "x", "de", "c"), (8, LONG, "en", "c"), (9, LONG, "en", "a"), (10, "naïve Ünïcode 😀 text here", "fr", "b"),
    (10, "another text under the same id", "fr", "é"),
]


@pytest.fixture
def odd(spark):
    return documents(spark, ODD, extra=True)


@pytest.fixture
def none(spark):
    return documents(spark, [], extra=True)
