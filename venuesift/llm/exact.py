"""Exact duplicates of whole texts, found in salted stages that compare the full content.

Only DataFrame functions are used. Copies meet in three steps: every task first combines the
copies it reads (the map side of the aggregation), then copies with the same digest and the
same salt are merged, and last the winners of the salts. Each step groups by the text itself,
so that texts which only share a digest are never taken for copies.

Defined results: a null text is an empty one; a null id is smaller than any other, so it stays
only where no copy has an id; of rows that repeat one id and one text exactly one stays. An
empty table gives an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuesift.llm.common import text_of
from venuesift.operators.lookup import hashable_columns, lookup_join
from venuesift.session import cut_lineage

#: The copies of one text are dealt into so many parts before they meet.
SALTS = 64
#: Repeated rows are written out again in steps of this size.
_STEP = 10_000


def winners(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each different text: ``digest``, ``keep`` (its largest id), ``n`` (rows).

    A digest that two texts share ends the job, because it then no longer names one text;
    the comparison of whole texts is what finds that.
    """
    text = text_of(docs, text_col)
    rows = docs.select(
        text.alias("content"), F.sha2(text, 256).alias("digest"), docs[id_col].alias("id"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(SALTS)).alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("id"), F.count(F.lit(1)).alias("n")
    )
    whole = salted.groupBy("digest", "content").agg(F.max("id").alias("keep"), F.sum("n").alias("n"))
    by_digest = whole.groupBy("digest").agg(
        F.max("keep").alias("keep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents")
    )
    clash = F.raise_error(F.concat(F.lit("two texts share the SHA-256 "), F.col("digest"))).cast("long")
    return by_digest.select(
        "digest", "keep", F.when(F.col("contents") == 1, F.col("n")).otherwise(clash).alias("n")
    )


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id, keep, n, kept, digest``.

    Rows go to the join without their texts and once for each (digest, id). The rows of a text with very many
    copies are dealt over several tasks, each of which gets the winner.
    """
    slim = docs.select(
        docs[id_col].alias("id"), F.sha2(text_of(docs, text_col), 256).alias("digest")
    ).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"))
    tops = cut_lineage(winners(docs, text_col, id_col), "winners")
    met = lookup_join(slim, tops, ["digest"], counts=tops, spread=["id"])
    steps = met.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _STEP))))
    left = F.least(F.lit(_STEP).cast("long"), F.col("copies") - F.col("step") * _STEP)
    each = steps.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    first = (F.col("at") == 1) & (F.col("step") == 0)
    return each.select("id", "keep", "n", (F.col("id").eqNullSafe(F.col("keep")) & first).alias("kept"), "digest")


def drop_exact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows that repeat id and text are cut to one before they are shuffled; then the id and digest
    of the winner pick its row, so that copies spread over the tasks by their ids.
    """
    def key(column: Column) -> Column:
        """Never null, so that window and join want the same partitions."""
        return F.coalesce(column.cast("string"), F.lit("none")).alias("id_key")

    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), key(docs[id_col]),
        F.sha2(text_of(docs, text_col), 256).alias("digest"),
    )
    repeats = Window.partitionBy("digest", "id_key").orderBy(F.xxhash64(*[F.col("row")[c] for c in hashable_columns(docs)]))
    once = rows.withColumn("at", F.row_number().over(repeats)).filter(F.col("at") == 1)
    top = winners(docs, text_col, id_col).select("digest", key(F.col("keep")))
    return once.join(top, ["digest", "id_key"], "left_semi").select("row.*")
