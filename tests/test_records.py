from __future__ import annotations

import csv

import pandas as pd
import pytest
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.operators.ordering import limit_records
from venuesift.sources import records as REC


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


HEADER = ["expected_label", "id", "extra", "name", "evidence_text"]


def test_read_selects_by_name_and_keeps_order(spark, tmp_path):
    path = write(tmp_path / "in.csv", HEADER, [
        ["yes", "a", "1", "Ann, Inc.", 'line 1\nline "2"'],
        ["", "b", "2", "None", " x "],
        ["NA", "n/a", "3", "Nil", "NaN"],
        ["  ", " ", "4", "é", "y"],
    ])
    rows = REC.read_records(spark, path).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [
        (0, "a", "Ann, Inc.", 'line 1\nline "2"', "yes"),
        (1, "b", None, " x ", None),
        (2, None, "Nil", None, None),
        (3, " ", "é", "y", "  "),
    ]


def test_missing_tokens_are_those_of_pandas(spark, tmp_path):
    values = [*C.NA_TOKENS[1:], "na", "none", "Null", "#n/a", "0", "-"]
    path = write(tmp_path / "na.csv", ["id", "name"], [[str(i), v] for i, v in enumerate(values)])
    ours = [r.name for r in REC.read_records(spark, path).orderBy("seq").collect()]
    theirs = pd.read_csv(path, dtype=str, keep_default_na=True)["name"]
    assert ours == [None if pd.isna(v) else v for v in theirs]


def test_missing_columns_reject_all_rows(spark, tmp_path):
    path = write(tmp_path / "short.csv", ["id", "name"], [["1", "x"], ["2", "y"]])
    records = REC.read_records(spark, path)
    assert REC.validate_records(records).count() == 0
    assert {r.reject_reason for r in REC.rejected_records(records).collect()} == {"evidence_text is missing"}


def test_many_files_are_numbered_by_path(spark, tmp_path):
    for name, size in (("b 1.csv", 3), ("a.csv", 50), ("c%.csv", 1)):
        write(tmp_path / "many" / name, ["id", "name", "evidence_text"],
              [[f"{name}-{i}", "n", "t" * (size if i else 2000)] for i in range(size)])
    rows = REC.read_records(spark, str(tmp_path / "many")).orderBy("seq").collect()
    assert [r.id for r in rows] == [
        f"{name}-{i}" for name, size in (("a.csv", 50), ("b 1.csv", 3), ("c%.csv", 1)) for i in range(size)
    ]
    assert len({r.seq for r in rows}) == 54


def test_each_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "mixed"
    write(folder / "a.csv", ["id", "name", "evidence_text", "expected_label"], [["1", "n1", "t1\nx", "yes"]])
    write(folder / "b.csv", ["evidence_text", "expected_label", "id, too", "id", "extra", "name"], [["t2", "no", "?", "2", "e", "n2"]])
    write(folder / "c.csv", ["name"], [["n3"], ["n4"]])
    write(folder / "d.csv", ["id", "name", "evidence_text", "expected_label"], [])
    rows = REC.read_records(spark, str(folder)).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("1", "n1", "t1\nx", "yes"), ("2", "n2", "t2", "no"), (None, "n3", None, None), (None, "n4", None, None)]


def test_bad_rows_are_set_aside(spark):
    frame = spark.createDataFrame([
        (0, "a", "n", "t", "yes"), (1, None, "n", "t", "yes"), (2, "c", "n", "t", "maybe"),
        (3, "d", "n", "t", " \t"), (4, "e", "n", "t", None), (5, "f", "n", "t", " yes"), (6, " ", "n", "t", "no"),
    ], "seq long, id string, name string, evidence_text string, expected_label string")
    good = {r.seq: r.expected_label for r in REC.validate_records(frame).collect()}
    assert good == {0: "yes", 3: None, 4: None, 6: "no"}
    bad = {r.seq: r.reject_reason for r in REC.rejected_records(frame).collect()}
    assert bad == {1: "id is missing", 2: "expected_label is not a known label",
                   5: "expected_label is not a known label"}


def test_seed_state_starts_empty(spark):
    frame = spark.createDataFrame([(0, "a", "n", "t", "yes")],
                                  "seq long, id string, name string, evidence_text string, expected_label string")
    row = REC.seed_state(frame).first()
    assert (row.restaurant_id, row.raw_text, row.needs_review, row.evidence) == ("a", "t", False, [])
    assert row.cleaned_text is row.prediction is row.confidence is row.error is row.validation_status is None


@pytest.mark.parametrize("n", [0, 1, 7, 2999, 3000, 10_000_000_000])
def test_limit(spark, n):
    rows = spark.range(3000).select((F.col("id") * 1500).alias("seq"), F.col("id").alias("v"))
    got = limit_records(rows.repartition(5), n).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(i * 1500, i) for i in range(min(n, 3000))]


@pytest.mark.parametrize("n", [1, 4999, 70_000, 199_999, 200_000])
def test_limit_of_numbers_all_over_the_range(spark, n):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("seq"))
    got = limit_records(rows, n)
    want = sorted(r.seq for r in rows.collect())[:n]
    assert sorted(r.seq for r in got.collect()) == want
    assert "Window" not in got._jdf.queryExecution().toString()


def test_limit_with_most_numbers_in_one_place(spark):
    rows = spark.range(300_000).select(F.col("id").alias("seq")).unionByName(
        spark.createDataFrame([(-(1 << 62),), (1 << 62,)], "seq long"))
    got = limit_records(rows, 250_000)
    assert got.count() == 250_000 and got.agg(F.max("seq")).first()[0] == 249_998


def test_limit_at_the_edges_of_a_block(spark):
    rows = spark.range(0, 1_000_000, 512).withColumnRenamed("id", "seq")
    for n in (255, 256, 257, 512, 1000):
        got = limit_records(rows, n)
        assert got.count() == n and got.agg(F.max("seq")).first()[0] == (n - 1) * 512
    with pytest.raises(ValueError):
        limit_records(rows, -1)
