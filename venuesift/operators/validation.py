"""Validation stage: status, review flag and the error of impossible confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R

_BAD_CONFIDENCE = "confidence is outside the range 0.0 to 1.0"


def validate_predictions(df: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Set ``validation_status`` and ``needs_review``.

    An empty error text is no error here. A missing confidence counts as 0.0. One
    outside its range breaks the contract of a prediction: the row fails and keeps
    its prediction.
    """
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    no_prediction = F.coalesce(F.col("error") != "", F.lit(False)) | F.col("prediction").isNull()
    broken = ~R.confidence_valid(confidence)
    review = R.needs_review(F.col("prediction"), confidence, F.col("evidence"), threshold)
    return (
        df.withColumn(
            "validation_status",
            F.when(no_prediction | broken, "failed").when(review, "flagged").otherwise("ok"),
        )
        .withColumn("needs_review", F.col("validation_status") != "ok")
        .withColumn(
            "error",
            F.when(~no_prediction & broken, F.lit(_BAD_CONFIDENCE)).otherwise(F.col("error")),
        )
    )


def route_records(df: DataFrame) -> DataFrame:
    return df.withColumn("route", R.route(F.col("validation_status"), F.col("needs_review")))
