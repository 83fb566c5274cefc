"""Small tables that the operator tests share."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

#: NULLs in every column, empty and very long texts, ties, repeated rows, clashing extra columns.
EDGE_ROWS = [
    (0, "It's a test, they'll see.  Two  spaces\n\n and 12 numbers ½ ²³ 日本語 🙂", "en", 1),
    (1, None, "en", None),
    (2, "", None, 0),
    (3, "a" * 70_000, "xx", 3),
    (3, "a" * 70_000, "xx", 3),
    (4, "word " * 30_000, "en", 5),
    (None, "no id here", "en", 6),
    (5, "<|endoftext|> in <|endoftext|>text<|endoftext|", "en", 7),
    (6, " \t\n ", "en", 8),
    (7, "'s's 't're'rex ''ll 'VE x'd'", "en", 9),
]
EDGE_SCHEMA = "doc_id bigint, text string, lang string, n_tokens int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
