"""Cleaning stage over a text column.

The steps are separate projections because later steps use an earlier result
several times; one nested expression would compute it again for each use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.functions import text as X


def strip_boilerplate(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Tags, entities, header lines and separator lines.

    Only texts with an entity outside the common set reach the Python stage; for
    every other row that stage receives a null, so no text crosses to Python.
    """
    untagged = df.withColumn("_untagged", X.drop_tags(F.col(text_col)))
    flagged = untagged.withColumn("_rare", X.has_rare_entity(F.col("_untagged")))
    decoded = flagged.withColumn(
        "_by_table", X.decode_all_entities(F.when(F.col("_rare"), F.col("_untagged")))
    )
    plain = X.decode_common_entities(F.col("_untagged"))
    text = F.when(F.col("_rare"), F.col("_by_table")).otherwise(plain)
    return (
        decoded.withColumn("_decoded", text)
        .withColumn(out, X.drop_boilerplate_lines(F.col("_decoded")))
        .drop("_untagged", "_rare", "_by_table", "_decoded")
    )


def clean_evidence(df: DataFrame, text_col: str, out: str = "cleaned_text") -> DataFrame:
    bare = strip_boilerplate(df, text_col, "_bare")
    return (
        bare.withColumn("_lines", X.one_line_end(F.col("_bare")))
        .withColumn("_single", X.single_blanks(F.col("_lines")))
        .withColumn(out, X.trim_lines(F.col("_single")))
        .drop("_bare", "_lines", "_single")
    )
