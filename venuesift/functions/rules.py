"""Review rules as boolean expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions.text import strip_seldom


def confidence_valid(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))


def supporting_evidence(label: Column, quotes: Column) -> Column:
    """``unknown`` needs no quote; the other labels need one that is not blank."""
    has_quote = F.exists(quotes, lambda quote: F.coalesce(strip_seldom(quote) != "", F.lit(False)))
    return (label == "unknown") | F.coalesce(has_quote, F.lit(False))


def needs_review(label: Column, confidence: Column, quotes: Column, threshold: float) -> Column:
    return (
        ~confidence_valid(confidence)
        | (confidence < F.lit(float(threshold)))
        | ~supporting_evidence(label, quotes)
    )


def is_failed(error: Column, status: Column) -> Column:
    """An empty error text counts as failed here; only a missing one does not."""
    return error.isNotNull() | F.coalesce(status == "failed", F.lit(False))


def is_correct(prediction: Column, expected: Column, error: Column, status: Column) -> Column:
    return F.when(~is_failed(error, status), prediction == expected)


def route(status: Column, review: Column) -> Column:
    return (
        F.when(status == "failed", "failed")
        .when(review, "needs_review")
        .otherwise("success")
    )


def rank(value: Column, table: dict[str, int]) -> Column:
    """Position of a value in a small rank table; an unknown value is an error."""
    chain = None
    for name, position in table.items():
        chain = (F if chain is None else chain).when(value == name, F.lit(position))
    return chain.otherwise(F.raise_error(F.concat(F.lit("no rank for "), value)).cast("int"))


def default_reliability(source_type: Column) -> Column:
    chain = None
    for name, level in C.DEFAULT_RELIABILITY.items():
        chain = (F if chain is None else chain).when(source_type == name, F.lit(level))
    return chain
