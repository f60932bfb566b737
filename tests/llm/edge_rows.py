"""Texts, schemas and fixtures that the tests of this folder share."""

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_texts():
    """Texts at the edges: missing, empty, blank, without letters, repeated, with marks of the formats, very long."""
    return [
        None, "", " ", "\n\t ", "12 34 !?", "one", "one two", "The cat's got 3 lives, they'll say.", "same words here again and again",
        "same words here again and again", "<|endoftext|> in a text<|endoftext|>", "naïve café — 漢字 😀 \x00 \x85",
        "x" * 30000, "word " * 20000, "\u0000" * 3000, "a" * 64, "ÿ" * 4097,
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts())]
    rows += [(None, "a row without an id", None, None, None), (3, "\n\t ", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    # names that operators use for their own columns
    return df.withColumns({c: F.lit("kept") for c in ("r", "score", "spans", "pii", "late", "language", "_read", "h", "key")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
