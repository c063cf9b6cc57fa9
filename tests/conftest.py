from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master(f"local[{min(8, os.cpu_count() or 1)}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from venuesift.session import configure

    return configure(session)


@pytest.fixture()
def out_of(spark):
    """Apply a column function to Python strings and return Python values."""
    def run(expression, texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.o for r in frame.select("i", expression(frame.t).alias("o")).orderBy("i").collect()]

    return run
