"""Requests of a gather job: checking rows before the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_requests(requests: DataFrame) -> DataFrame:
    """Name the first reason why a request cannot be answered."""
    reason = F.coalesce(
        F.when(F.col("name").isNull(), "name is missing"),
        F.when(F.col("city").isNull(), "city is missing"),
    )
    return requests.withColumn("reject_reason", reason)


def validate_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).filter(F.col("reject_reason").isNotNull())
