"""The folder for tables between steps, where a local session names none."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def name_folder(spark: SparkSession) -> SparkSession:
    """Give a session on this machine alone a folder here, unless it names one itself."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark
