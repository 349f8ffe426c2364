from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("sid", T.StringType()), T.StructField("block", T.StringType()), T.StructField("blob", T.StringType()),
        T.StructField("score", T.StringType()), T.StructField("row", T.StringType()), T.StructField("content", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` pairs; every other column is null or clashes."""

    def build(pairs, lang="en"):
        rows = [(i, t, lang, None, None, "s", "b", "c", "d", "e", None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and very long texts, repeated rows, several scripts."""
    long = "word " * 40_000
    pairs = [
        (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "a" * 5_000), (6, "Same text here, twice over."),
        (7, "Same text here, twice over."), (7, "Same text here, twice over."), (None, "no id at all"),
        (8, "Zoë's naïve café — 東京 2024 ok\x1cend"), (9, "x"),
    ]
    return documents(pairs)


def table(rows):
    return [row.asDict() for row in rows.collect()]
