import pytest
from pyspark.sql import types as T

#: The columns of documents, and others whose names the operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("row", "key", "size", "digest", "score", "slot", "n", "_id")],
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """``rows``: (doc_id, text[, source])."""
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *["x"] * 8) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "one two three four five six"),
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (3, ""),
    (None, "no id here at all"),
    (None, "no id here at all"),
    (None, None, None),
    (4, "same text as five", None),
    (5, "same text as five", "b"),
    (6, "Same TEXT as five", "b"),
    (7, "É é ß 😀 \u2003 tabs\tand\x0blines\n"),
    (8, "word " * 60_000),
    (9, "x" * 300_000),
    (10, " \t\n "),
]
