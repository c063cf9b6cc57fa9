"""Result tables and their export as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R
from venuesift.functions.jsontext import json_list


def with_results(state: DataFrame) -> DataFrame:
    """Working rows with ``is_correct``, and the quotes as JSON text."""
    correct = R.is_correct(
        F.col("prediction"), F.col("expected_label"), F.col("error"), F.col("validation_status")
    )
    return state.withColumns({"is_correct": correct, "evidence": json_list(F.col("evidence"))})


def in_order(rows: DataFrame) -> DataFrame:
    """The result columns of rows ``with_results``, in input order. Call it on saved rows: what a sort reads is
    computed twice, as Spark takes a sample first."""
    return rows.orderBy("seq").select(*C.RESULT_COLUMNS)


def results_rows(state: DataFrame) -> DataFrame:
    """The result columns, with quotes as JSON text, in input order."""
    return in_order(with_results(state))


def review_queue(state: DataFrame) -> DataFrame:
    """Rows for people to look at. Call it on saved rows: Spark would move the filter
    below the stages that compute the flag and run them once more for it."""
    return results_rows(state.filter("needs_review"))


PROVENANCE_LISTS = ["source_evidence_snippets", "source_urls", "source_types"]


def lists_as_json(venues: DataFrame, columns: list[str]) -> DataFrame:
    """List columns as JSON text. Done for each venue, before requests are attached."""
    return venues.withColumns({name: json_list(F.col(name)) for name in columns})


def gather_results_rows(state: DataFrame) -> DataFrame:
    """The gather columns in request order."""
    return state.orderBy("seq").select(*C.GATHER_COLUMNS)


def gather_review_queue(state: DataFrame) -> DataFrame:
    """As ``review_queue``, for gathered rows; call it on saved rows."""
    return gather_results_rows(state.filter("needs_review"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; missing and empty cells are blank, booleans are True and False."""
    flags = [f.name for f in rows.schema if f.dataType.typeName() == "boolean"]
    text = rows.withColumns({
        name: F.when(F.col(name), "True").when(~F.col(name), "False") for name in flags
    })
    text.write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
