from __future__ import annotations

import csv
import io
import random

import pandas as pd
import pytest

from venuesift.session import session_values
from venuesift.sources import csvtext
from venuesift.sources.records import read_records

NAMES = ("id", "name", "evidence_text", "expected_label")


def random_csv(seed, rows=120):
    """Quoted cells with all kinds of line breaks, quotes and commas; a header with a line break and a comma."""
    chance = random.Random(seed)
    parts = ["a", "b c", '"', '""', ",", "\n", "\r\n", "\r", "é", "", "\t", "long " * 9]

    def cell():
        return "".join(chance.choice(parts) for _ in range(chance.randint(0, 5)))

    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=chance.choice(["\n", "\r\n"]))
    writer.writerow(["note\nmore, and \"more\"", *NAMES])
    for i in range(rows):
        writer.writerow([cell(), f"r{i}", cell(), cell(), chance.choice(["yes", "no", ""])])
        if chance.random() < 0.05:
            out.write("\n")
    return out.getvalue()


def told(frame):
    return [(r.id, r.name, r.evidence_text, r.expected_label) for r in frame.orderBy("seq").collect()]


def by_pandas(text):
    frame = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=True)
    return [tuple(None if pd.isna(v) else v for v in row) for row in frame[list(NAMES)].itertuples(index=False)]


@pytest.mark.parametrize(("seed", "size", "rows"), [(0, "60b", 12), (1, "700b", 60), (2, "700b", 60), (2, "64m", 60)])
def test_one_file_over_many_ranges(spark, tmp_path, seed, size, rows):
    text = random_csv(seed, rows)
    path = tmp_path / "one.csv"
    path.write_text(text, newline="", encoding="utf-8")
    with session_values(spark, {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}):
        frame = read_records(spark, str(path))
        assert told(frame) == by_pandas(text)
        assert [r.seq for r in frame.orderBy("seq").collect()] == list(range(rows))


def test_joined_ranges_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csvtext, "MOST_RANGES", 0)
    monkeypatch.setattr(csvtext, "MOST_FILES", 0)
    texts = [random_csv(seed, 15) for seed in (5, 6)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text, newline="", encoding="utf-8")
    with session_values(spark, {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1"}):
        assert told(read_records(spark, str(tmp_path))) == [row for text in texts for row in by_pandas(text)]


@pytest.mark.parametrize(("text", "rows"), [
    ("id,name\n1,a\"b\n2,\"c\" d\"e\n", [("1", 'a"b'), ("2", 'c d"e')]),
    ("id,name\r1,x\r2,y", [("1", "x"), ("2", "y")]),
    ("﻿id,name\n1,x\n", [("1", "x")]),
    ("id,name\n1\n2,y,z\n \t\n\n", [("1", None), ("2", "y")]),
    ("id,name\n", []),
    ("id,name\n1,\"never\nclosed", [("1", "never\nclosed")]),
    ("\"id\",\"na\nme\",name\n1,2,3", [("1", "3")]),
])
def test_small_files(spark, tmp_path, text, rows):
    path = tmp_path / "small.csv"
    path.write_text(text, newline="", encoding="utf-8")
    for size in ("7b", "64m"):
        with session_values(spark, {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}):
            assert [(r.id, r.name) for r in read_records(spark, str(path)).orderBy("seq").collect()] == rows


def test_effects_of_lines_compose():
    for line in ('a,"b', 'c"', '"', '""', 'x"y', '","', '"a""b",c', "plain", '"q" "z'):
        for inside in (False, True):
            cuts, after = csvtext.line_effect(line, inside)
            reader = list(csv.reader(io.StringIO(('"' if inside else "") + line + '\n~', newline="")))
            assert cuts == [] and after == (len(reader) == 1)
