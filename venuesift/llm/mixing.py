"""Mixing sources to target weights by systematic sampling.

Sources get shares of ``budget`` times all words by their weights; a target stops at ``most`` times
the size of its source, and what is over goes to the others by weight until none is above. Inside a
source all documents have the same expected copies, target / size. They stand in order of
size (then id); their expected copies are summed up from the front, one random offset is added
for the source, and a document is emitted once for each whole number its part of the sum
crosses. Because neighbours in that order are of about equal size, the words taken stay within about one
document of the target.

Places in the order come from a range-partitioned sort (``rank_rows``), so that a source with most of
the rows is spread over all tasks.

Defined results: a null text has size 0; a null source is a source of its own, the last; a
source without words has target 0 and gives nothing; rows that repeat one id are sampled one by
one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import WORD, text_of
from venuesift.operators.ordering import rank_rows
from venuesift.session import cut_lineage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"
#: Expected copies are counted in parts of 1 / 2**30.
_BITS = 30


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST
) -> DataFrame:
    """``sizes`` (``source, place, words``; one row per source, ``place`` from 0) with ``target``.

    All shares per unit of weight are equal to one level; each pass sets aside the sources
    that reach their limit at the level and spreads the rest again. Only sums reach the
    driver, and the passes end when no further source is set aside.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumns({"weight": weight.cast("long"), "limit": F.col("words") * most})
    total = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    level, aside = 0.0, -1
    while True:
        at_limit = F.col("limit") <= F.lit(level) * F.col("weight") if aside >= 0 else F.lit(False)
        n, full, open_weight = rows.agg(
            F.count(F.when(at_limit, 1)), F.coalesce(F.sum(F.when(at_limit, F.col("limit"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)),
        ).first()
        if n == aside or not open_weight:
            break
        level, aside = (budget * total - full) / open_weight, n
    target = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target).drop("weight", "limit")


def _offset(seed: str, source: Column) -> Column:
    """A number from 0 to 2**30 - 1 drawn for the source by a digest of seed and name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("none")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << _BITS) - 1))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED,
    text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", carry: bool = False,
) -> DataFrame:
    """``id, source, size, words, target, copies`` of each row; ``words`` and ``target`` are
    those of its source.

    With ``carry`` the whole row comes along as ``row``.
    """
    rows = docs.select(
        docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
        F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    rows = cut_lineage(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("words")).withColumn("all", F.lit(1))
    order = sums.withColumns({"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    placed = rank_rows(order, ["all"], ["none", "name"], "nth").withColumn("place", F.col("nth") - 1)
    targets = cut_lineage(
        source_targets(placed.select("source", "place", "words"), weights, budget, most), "targets"
    ).withColumnRenamed("source", "named")
    met = rows.join(targets, rows["source"].eqNullSafe(targets["named"])).drop("named")
    ranked = rank_rows(met, ["place"], ["size", "id"], "nth")
    unit = 1 << _BITS
    step = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") * unit)).otherwise(F.lit(0))
    part = step.cast("long").bitwiseAND(F.lit(unit - 1))
    before = (((F.col("nth") - 1) % unit) * part + _offset(seed, F.col("source"))) % unit
    copies = F.shiftright(step.cast("long"), _BITS) + F.shiftright(before + part, _BITS)
    return ranked.select("id", "source", "size", "words", "target", copies.alias("copies"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as the mix takes it."""
    taken = mix(docs, carry=True, **options).filter(F.col("copies") > 0)
    each = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("row.*")
