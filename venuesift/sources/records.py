"""Records: reading a CSV, checking rows, and the starting state of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions.text import strip_seldom
from venuesift.operators.lookup import lookup_join
from venuesift.operators.ordering import rank_rows
from venuesift.sources.csvtext import MOST_FILES, read_columns

_ROW_BITS = 33


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Four text columns, with missing-value tokens as null, and ``seq``.

    Every file has a header of its own, and columns are taken by its names. ``seq`` numbers
    rows by file path, then by place in the file. Cells may hold line breaks; a large file is read by many tasks.
    """
    fields = tuple(C.RECORD_FIELDS)
    named, files = read_columns(spark, path, fields)
    listed = files.withColumn("all", F.lit(1))
    places = rank_rows(listed, ["all"], ["file"]).select("file", "rank")
    seq = F.shiftleft(F.col("rank") - 1, _ROW_BITS) + F.col("row")
    # Files are few beside their rows; one file may hold most rows.
    met = named.join(F.broadcast(places), "file") if files.count() <= MOST_FILES else lookup_join(named, places, ["file"], spread=["row"])
    return met.select(
        seq.alias("seq"), *[F.when(~F.col(name).isin(*C.NA_TOKENS), F.col(name)).alias(name) for name in fields]
    )


def check_records(records: DataFrame) -> DataFrame:
    """Make blank labels null and name the first reason why a row cannot be used."""
    label = F.when(strip_seldom(F.col("expected_label")) != "", F.col("expected_label"))
    reason = F.coalesce(
        F.when(F.col("id").isNull(), "id is missing"),
        F.when(F.col("name").isNull(), "name is missing"),
        F.when(F.col("evidence_text").isNull(), "evidence_text is missing"),
        F.when(~F.col("expected_label").isin(*C.LABELS), "expected_label is not a known label"),
    )
    return records.withColumn("expected_label", label).withColumn("reject_reason", reason)


def validate_records(records: DataFrame) -> DataFrame:
    return check_records(records).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_records(records: DataFrame) -> DataFrame:
    return check_records(records).filter(F.col("reject_reason").isNotNull())


def seed_state(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Working rows of a job: record columns kept for the output (and ``keep``), all else empty."""
    def empty(kind: str):
        return F.lit(None).cast(kind)

    return records.select(
        "seq",
        F.col("id").alias("restaurant_id"),
        "name",
        "expected_label",
        F.col("evidence_text").alias("raw_text"),
        empty("string").alias("cleaned_text"),
        empty("string").alias("prediction"),
        empty("double").alias("confidence"),
        F.array().cast("array<string>").alias("evidence"),
        empty("string").alias("reasoning"),
        empty("string").alias("validation_status"),
        F.lit(False).alias("needs_review"),
        empty("string").alias("error"),
        *keep,
    )
