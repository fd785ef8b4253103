from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Nulls, empty, blank and long texts, repeated rows, and columns whose names clash with those that operators add.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nLine two here.\nLine three.", "en"),
    (1, "The quick brown fox jumps over the lazy dog.\nLine two here.\nLine three.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n \n ", "fr"),
    (5, "word " * 60_000, "en"),
    (None, "no id at all", "de"),
    (6, "x" * 200_000, None),
    (7, "The quick brown fox jumps over the lazy dog.\nLine two here.\nLine three.", "en"),
    (8, "Émile à l’école, 東京\u3000タワー 😀 +1 (555) 123-4567 a.b@c.de", "fr"),
]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "n_chars", "key", "a", "b", "w", "starts", "length", "rank", "part", "src", "dst", "node", "component", "bucket", "score", "kept", "n", "label", "quality")]
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*row, *[None] * 20) for row in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
