"""Small documents with columns whose names clash with those the operators use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASHING = ("id", "row", "digest", "keep", "n", "fp", "size", "nth", "copies", "score", "content", "label", "place", "u")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{name}` string" for name in CLASHING
)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [
        (row[0], row[1], None, row[2] if len(row) > 2 else "s", None, *(f"x{i}" for i in range(len(CLASHING))))
        for row in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def sorted_rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=lambda row: tuple((v is None, v) for v in row))


#: Repeated rows, ties, null ids and texts, empty and blank texts, and one very long text.
ODD = [
    (5, "one two three four"), (5, "one two three four"), (9, "one two three four"), (None, "one two three four"),
    (1, None), (2, ""), (3, " \n\t"), (None, None), (7, "One two three four"), (8, "ü € 𝄞 x"),
    (4, "long " * 60_000 + "end"),
]
