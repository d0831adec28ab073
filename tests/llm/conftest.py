"""Rows that no operator may stumble over."""

import pytest

CLASH = ["kept", "score", "length", "cut", "gone", "want", "block", "sig", "rank", "n_tokens", "host", "_stage", "ids", "masked"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated ids and rows, columns of names that operators use."""
    long = " ".join(f"word{k % 977} AKIA{k:016d}"[: 9 + k % 5] for k in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "a text without an id, in a few words", "en", "src1", 36), (1, "", "en", "src1", 0), (2, " \n\t ", "en", "src2", 4), (3, long, "en", "src3", len(long)), (4, "the same words in the same order again", "en", "src1", 38),
        (5, "the same words in the same order again", "en", "src2", 38), (5, "the same words in the same order again", "en", "src2", 38), (6, "a repeated id with other words than before", "de", None, 42), (6, "a repeated id with yet another line of text", "de", "src4", 43), (7, "!!! ???", None, "src5", 7),
        (8, "日本語のテキスト😀 ünïcode\u0000 x", "ja", "src6", 24), (9, "one", "en", "nowhere", 3), (10, "x" * 5000, "en", "src7", 5000),
    ]
    rows = [r + tuple(f"{c}{k}" for c in CLASH) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture
def none(docs):
    return docs.limit(0)
