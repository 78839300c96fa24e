"""Fixtures of the llm tests: awkward documents, and the small documents table."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns whose names clash with those the operators return or use inside.
        T.StructField("score", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("copies", T.StringType()),
    ]
)

LINE = "this boilerplate line sits on many sites"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))


def awkward_rows() -> list[tuple]:
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b", 45),
        (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b", 45),  # a repeated row
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", None, 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "ein", "de", "c", 3),
        (None, "no id here at all my friend", "en", "a", 27),
        (8, "12 345 !!!", None, "a", 10),
    ]
    rows += [(20 + i, f"{LINE}\nown text number {i} of site {i}", "en", f"s{i}", 70) for i in range(6)]
    return [(*r, "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
