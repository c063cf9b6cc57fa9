"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the library relies on; all can be set at run time."""
    # A JSON object that repeats a key keeps the last value.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def session_values(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; afterwards they are what they were."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut_lineage(df: DataFrame, label: str = "rows", codec: str | None = None) -> DataFrame:
    """Write the rows once to a table in the shared folder and go on from that table.

    Later steps read only the columns they need, and nothing is computed again when an
    executor is lost.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    write_table(df, path, codec)
    table = spark.read.parquet(path)
    table._written_at = path
    return table


def write_table(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Write a table as Parquet; the shuffle files behind it are removed as soon as it is written."""
    with session_values(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        writer = df.write.mode("overwrite")
        (writer.option("compression", codec) if codec else writer).parquet(path)


def remove_tables(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, once everything made from them is written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
