"""Evaluation of predictions against expected labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R
from venuesift.operators.lookup import lookup_join
from venuesift.session import cut_lineage


def expected_labels(df: DataFrame, id_col: str, seq_col: str = "seq") -> DataFrame:
    """One row for each id: its last label that is not missing."""
    labelled = df.filter(F.col("expected_label").isNotNull())
    return labelled.groupBy(id_col).agg(
        F.max_by("expected_label", seq_col).alias("expected_for_id")
    )


def join_expected(df: DataFrame, id_col: str, seq_col: str = "seq") -> DataFrame:
    """Attach to each row the label that counts for its id.

    Labels and numbers of rows come from one aggregation; rows of an id that has very many of
    them are dealt over several tasks.
    """
    label = F.max_by("expected_label", F.when(F.col("expected_label").isNotNull(), F.col(seq_col)))
    per_id = cut_lineage(
        df.groupBy(id_col).agg(label.alias("expected_for_id"), F.count(F.lit(1)).alias("n")), "expected-labels"
    )
    return lookup_join(df, per_id.drop("n"), [id_col], "left", counts=per_id, spread=[seq_col])


def evaluate(
    df: DataFrame,
    threshold: float = C.DEFAULT_THRESHOLD,
    id_col: str = "restaurant_id",
    seq_col: str = "seq",
) -> DataFrame:
    """One row of metrics.

    The label of an id and the counts of its rows come out of the same aggregation,
    so the rows are not joined to anything. Counts and label codes are fixed-width,
    and they are combined before the shuffle: an id that holds many rows
    sends one small row from each task.
    """
    failed = R.is_failed(F.col("error"), F.col("validation_status"))
    usable = ~failed & F.col("prediction").isNotNull()
    code = F.array_position(F.array(*map(F.lit, C.LABELS)), F.col("expected_label")).cast("int")
    per_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~usable).alias("failures"),
        *[F.count_if(usable & (F.col("prediction") == name)).alias(name) for name in C.LABELS],
        F.count_if(usable & (F.col("confidence") < F.lit(float(threshold)))).alias("low"),
        F.count_if("needs_review").alias("review"),
        F.max_by(code, F.when(F.col("expected_label").isNotNull(), F.col(seq_col))).alias("code"),
    )

    def total(value, condition=None):
        picked = value if condition is None else F.when(condition, value).otherwise(0)
        return F.coalesce(F.sum(picked), F.lit(0))

    labelled = F.col("code").isNotNull()
    label_is = {name: F.col("code") == place for place, name in enumerate(C.LABELS, start=1)}
    evaluated = sum((F.col(name) for name in C.LABELS), F.lit(0))
    right = sum((F.when(label_is[name], F.col(name)).otherwise(0) for name in C.LABELS), F.lit(0))
    not_yes = F.col("no") + F.col("unknown")

    totals = per_id.agg(
        total(F.col("rows")).alias("total_records"),
        total(F.col("failures")).alias("failure_count"),
        total(F.col("low"), labelled).alias("low_confidence_count"),
        total(F.col("review")).alias("review_queue_count"),
        total(evaluated, labelled).alias("_evaluated"),
        total(right).alias("_right"),
        total(F.col("yes"), labelled).alias("_said_yes"),
        total(F.col("yes"), label_is["yes"]).alias("_true_yes"),
        total(F.col("yes"), labelled & ~label_is["yes"]).alias("false_positives"),
        total(not_yes, label_is["yes"]).alias("false_negatives"),
    )

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return totals.select(
        ratio(F.col("_right"), F.col("_evaluated")).alias("accuracy"),
        ratio(F.col("_true_yes"), F.col("_said_yes")).alias("precision_yes"),
        ratio(F.col("_true_yes"), F.col("_true_yes") + F.col("false_negatives")).alias("recall_yes"),
        "false_positives", "false_negatives", "low_confidence_count",
        "total_records", "failure_count", "review_queue_count",
    )
