"""Small tables of odd documents, and whole small tables as rows."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ("train", "block", "slice", "ids", "fp", "rank", "part", "q", "q_row", "gone", "n_lang", "held_out", "score", "rejected", "lang_pred", "component_id", "id", "key")

LONG = "und der the und " * 20_000
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, " \t\n ", "de", None, 4),
    (4, "the cat sat on the mat", "en", "a", None),
    (4, "the cat sat on the mat", "en", "a", None),
    (None, "a row without an id", None, "a", 1),
    (5, "Licensed under the MIT License. Licensed under the MIT License.", "en", "a", 1),
    (6, "x" * 70_000, "de", "b", 1),
    (7, LONG, "de", "b", 1),
    (8, "   wide　space\x1c\x1d 'tis 12345 \U0001f600\U0001f600 \r\n\r\n  end  ", "fr", "b", 1),
    (9, "one", None, None, None),
    (10, "abc <|endoftext|> def<|startoftext|>  <|ENDOFTEXT|>.", "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns of clashing names beside them."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    """(doc_id, text) of the whole small table; null texts are empty."""
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def fold(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5
