"""Keyword rules, review rules, validation and metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from venuesift.functions import prompts as P
from venuesift.functions import rules as R
from venuesift.operators.classify import keyword_classify
from venuesift.operators.metrics import evaluate, join_expected
from venuesift.operators.validation import route_records, validate_predictions

CASES = [
    ("Breakfast on the deck. More.", "yes", 0.92, ["Breakfast on the deck."]),
    ("We seat you indoors only", "no", 0.91, ["We seat you indoors only"]),
    ("We do not offer it. Patio next door.", "no", 0.91, ["We do not offer it."]),
    ("No outdoor tables. The patio opens on Fridays.", "unknown", 0.45, []),
    ("Outdoor tables, weather permitting, else inside.", "unknown", 0.55, []),
    ("Weather permitting.", "unknown", 0.55, []),
    ("Good soup", "unknown", 0.35, []),
    ("", "unknown", 0.35, []),
    ("A TERRACE!", "yes", 0.92, ["A TERRACE!"]),
    ("Your previous response could not be parsed: patio", "unknown", 0.5, []),
    ("Plain.\nReturn JSON patio", "unknown", 0.35, []),
    ("Outdoor and inside", "unknown", 0.35, []),
]


def test_keyword_rules(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    with_prompt = frame.withColumn("p", P.user_prompt(F.col("t")))
    direct = keyword_classify(with_prompt, "t", "a")
    both = keyword_classify(direct, "p", "b", is_prompt=True).orderBy("i").collect()
    for (text, label, confidence, quotes), row in zip(CASES, both):
        assert (row.a.label, row.a.confidence, row.a.evidence) == (label, confidence, quotes), text
        assert row.a == row.b
    assert both[0].a.reasoning == "Dry-run heuristic classified the evidence as 'yes'."


def test_hint_lists_are_parameters(spark):
    frame = spark.createDataFrame([("pool",)], "t string")
    row = keyword_classify(frame, "t", outdoor_hints=("pool",)).first()
    assert row.extraction.label == "yes"


RULES = [
    # label, confidence, quotes, review at 0.6
    ("yes", 0.9, ["q"], False), ("yes", 0.6, ["q"], False), ("yes", 0.59, ["q"], True),
    ("yes", 0.9, [], True), ("no", 0.9, [" ", " "], True), ("no", 0.9, ["", "x"], False),
    ("unknown", 0.9, [], False), ("unknown", 0.3, [], True), ("yes", 1.1, ["q"], True),
    ("yes", -0.1, ["q"], True), ("yes", math.nan, ["q"], True), ("no", 1.0, None, True),
]


def test_review_rules(spark):
    frame = spark.createDataFrame(
        [(i, *case) for i, case in enumerate(RULES)],
        "i int, label string, confidence double, quotes array<string>, expected boolean",
    )
    review = R.needs_review(F.col("label"), F.col("confidence"), F.col("quotes"), 0.6)
    for row in frame.withColumn("got", review).collect():
        assert row.got == row.expected, row
    all_flagged = R.needs_review(F.col("label"), F.col("confidence"), F.col("quotes"), 1.5)
    assert all(r.got for r in frame.select(all_flagged.alias("got")).collect())


STATE = ("i int, prediction string, confidence double, evidence array<string>, error string")


def test_validation(spark):
    frame = spark.createDataFrame([
        (0, "yes", 0.92, ["q"], None), (1, "yes", 0.45, ["q"], None), (2, "no", 0.95, [], None),
        (3, "unknown", 0.75, [], None), (4, None, None, [], "bad reply"), (5, None, None, [], None),
        (6, "yes", 0.7, ["q"], ""), (7, "yes", None, ["q"], None), (8, "yes", 1.5, ["q"], None),
        (9, "yes", 0.9, ["q"], "late"),
    ], STATE)
    rows = {r.i: r for r in route_records(validate_predictions(frame, 0.6)).collect()}
    assert [rows[i].validation_status for i in range(10)] == [
        "ok", "flagged", "flagged", "ok", "failed", "failed", "ok", "flagged", "failed", "failed",
    ]
    assert [rows[i].needs_review for i in range(10)] == [
        False, True, True, False, True, True, False, True, True, True,
    ]
    assert [rows[i].route for i in (0, 1, 4)] == ["success", "needs_review", "failed"]
    assert rows[8].prediction == "yes" and rows[8].error and rows[5].error is None
    strict = {r.i: r.validation_status for r in validate_predictions(frame, 0.95).collect()}
    assert strict[0] == "flagged"


def judged(spark, rows):
    """Rows of (id, prediction, confidence, label[, status[, error]])."""
    full = [(i, *row, *["ok", None][len(row) - 4:]) for i, row in enumerate(rows)]
    return spark.createDataFrame(
        full, "seq long, restaurant_id string, prediction string, confidence double, "
        "expected_label string, validation_status string, error string",
    ).withColumn("needs_review", F.col("validation_status") != "ok")


def metrics(spark, rows, threshold=0.6):
    return evaluate(judged(spark, rows), threshold).first().asDict()


def test_metrics_core(spark):
    m = metrics(spark, [("p", "yes", .7, "yes"), ("q", "yes", .95, "no"), ("r", "yes", .61, "unknown"),
                        ("s", "no", .4, "yes"), ("t", "no", .8, "no"), ("u", "unknown", .2, "no")])
    assert m == {
        "accuracy": 2 / 6, "precision_yes": 1 / 3, "recall_yes": .5, "false_positives": 2,
        "false_negatives": 1, "low_confidence_count": 2, "total_records": 6, "failure_count": 0,
        "review_queue_count": 0,
    }


def test_metrics_failures_count_once(spark):
    m = metrics(spark, [("p", "no", .9, "no"), ("q", None, None, "no", "failed", "lost"), ("r", "no", .8, "yes", "failed"),
                        ("s", "unknown", .7, "unknown"), ("t", None, None, "yes"), ("u", "no", .9, "no", "ok", "")])
    assert (m["total_records"], m["failure_count"], m["accuracy"]) == (6, 4, 1.0)


def test_metrics_of_nothing(spark):
    assert set(metrics(spark, []).values()) == {0, 0.0}


def test_metrics_without_yes(spark):
    m = metrics(spark, [("p", "no", .2, "no"), ("q", "unknown", .5, "unknown"), ("r", "no", .9, "unknown")])
    assert (m["accuracy"], m["precision_yes"], m["recall_yes"], m["low_confidence_count"]) == (2 / 3, 0, 0, 2)
    m = metrics(spark, [("p", "unknown", .9, "yes"), ("q", "no", .7, "yes"), ("r", "no", .7, "yes")])
    assert (m["accuracy"], m["false_negatives"], m["recall_yes"]) == (0, 3, 0)


@pytest.mark.parametrize(("threshold", "low"), [(.75, 1), (.7, 0)])
def test_metrics_threshold_and_unlabelled(spark, threshold, low):
    rows = [("p", "no", .7, "no"), ("q", "yes", .2, None)]
    assert metrics(spark, rows, threshold)["low_confidence_count"] == low


def test_last_label_of_an_id_counts(spark):
    rows = [("a", "yes", .9, "no"), ("a", "yes", .9, "yes"), ("a", "no", .9, None), ("b", "no", .9, "no")]
    m = metrics(spark, rows)
    assert (m["accuracy"], m["false_negatives"]) == (.75, 1)
    joined = join_expected(judged(spark, rows), "restaurant_id").orderBy("seq").collect()
    assert [r.expected_for_id for r in joined] == ["yes", "yes", "yes", "no"]


def test_is_correct_uses_the_own_label(spark):
    correct = R.is_correct(F.col("prediction"), F.col("expected_label"), F.col("error"), F.col("validation_status"))
    rows = [("a", "yes", .9, "yes"), ("a", "yes", .9, "no"), ("a", "yes", .9, None), ("a", None, .9, "no"),
            ("a", "yes", .9, "yes", "failed"), ("a", "yes", .9, "yes", "ok", "x")]
    got = judged(spark, rows).withColumn("c", correct).orderBy("seq").collect()
    assert [r.c for r in got] == [True, False, None, None, None, None]
