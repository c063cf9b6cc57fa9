"""Keyword decisions from ranked evidence rows, for groups of any size.

The answer is that of the rules on the combined text of a group (``merging.combine_evidence``, then
cleaning), but that text is never put together. A block, one row of evidence, is cleaned and tested
by itself; what its group needs is the first rank at which each flag holds, the first with the closing
instruction, and the first that ends a sentence: numbers, combined before their shuffle.

Only a tag can join blocks: one that is open at the end of a block reaches to the next ``>`` of
the group. Such blocks are glued to what they continue; whether a tag is open is carried along the
ranks in two steps, over stretches of ranks and inside of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import text as X
from venuesift.operators import classify as K
from venuesift.operators.cleaning import clean_evidence
from venuesift.session import cut_lineage

_STRETCH = 4096


def block_text(source_type: Column, url: Column, snippet: Column) -> Column:
    shown = F.when(url != "", F.concat(F.lit(" "), url)).otherwise("")
    return F.concat(F.lit("["), source_type, F.lit("]"), shown, F.lit("\n"), snippet)


def _carry(rows: DataFrame, group: list[str], value: Column, out: str) -> DataFrame:
    """Add the last value that is not null of the rows with smaller ranks."""
    rows = rows.withColumns({"_value": value, "_stretch": F.floor(F.col("rank") / _STRETCH)})
    ends = rows.groupBy(*group, "_stretch").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("rank"))).alias("_end")
    )
    earlier = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*group, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    before = (
        Window.partitionBy(*group, "_stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(before))
    return (
        inside.join(starts, [*group, "_stretch"])
        .withColumn(out, F.coalesce("_inside", "_start"))
        .drop("_value", "_stretch", "_inside", "_start")
    )


def _glued(blocks: DataFrame, group: list[str]) -> DataFrame:
    """``group, rank, tail, cut, start`` of blocks that a tag joins to others.

    ``tail``: the block begins inside a tag; ``cut``: one that is closed later begins in it;
    ``start``: rank of the block that the first of the joined blocks is.
    """
    text = F.col("text")

    def last(char: str) -> Column:
        at = F.locate(char, F.reverse(text))
        return F.when(at > 0, F.length(text) - at + 1).otherwise(0)

    marks = cut_lineage(blocks.select(
        *group, "rank", text.contains(">").alias("closes"), (last("<") > last(">")).alias("opens")
    ), "tag-marks")
    last_close = marks.filter("closes").groupBy(*group).agg(F.max("rank").alias("last_close"))
    # A group without both cannot have a tag over several blocks.
    some = marks.join(last_close, group).join(
        marks.filter("opens").groupBy(*group).agg(F.min("rank").alias("first_open")), group
    ).filter(F.col("first_open") < F.col("last_close"))
    state = F.when(F.col("closes") | F.col("opens"), F.col("opens"))
    known = _carry(some, group, state, "inside").select(
        *group, "rank",
        (F.coalesce("inside", F.lit(False)) & (F.col("last_close") >= F.col("rank"))).alias("tail"),
        (F.col("opens") & (F.col("last_close") > F.col("rank"))).alias("cut"),
    )
    placed = _carry(known, group, F.when(~F.col("tail"), F.col("rank")), "before")
    return placed.filter(F.col("tail") | F.col("cut")).select(
        *group, "rank", "tail", "cut", F.when(F.col("tail"), F.col("before")).otherwise(F.col("rank")).alias("start")
    )


def segments(ranked: DataFrame, group: list[str]) -> DataFrame:
    """``group, rank, text``: blocks, with those that a tag joins put together.

    Joined, the texts are what is left of the combined text when the joining tags are gone. What tags join is written;
    other blocks are read where they are, and cross only where too many are joined for a broadcast.
    """
    blocks = ranked.select(
        *group, "rank", block_text(F.col("source_type"), F.col("url"), F.col("snippet")).alias("text")
    )
    glued = cut_lineage(_glued(blocks, group), "glued-blocks")
    if glued.isEmpty():
        return blocks
    met = blocks.join(glued, [*group, "rank"], "left")
    text = F.col("text")
    after = F.substring(text, F.locate(">", text) + 1, F.length(text))
    rest = F.when(F.col("tail"), F.when(text.contains(">"), after).otherwise("")).otherwise(text)
    behind = F.substring_index(F.col("rest"), ">", -1)
    head = F.substring(
        F.col("rest"), F.lit(1), F.length("rest") - F.length(behind) + F.locate("<", behind) - 1
    )
    parts = met.filter(F.col("start").isNotNull()).withColumn("rest", rest).withColumn(
        "part", F.when(F.col("cut") & behind.contains("<"), head).otherwise(F.col("rest"))
    )
    joined = parts.groupBy(*group, F.col("start").alias("rank")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), "part"))).alias("parts")
    ).select(*group, "rank", F.array_join(F.transform("parts", lambda p: p.part), " ").alias("text"))
    return met.filter(F.col("start").isNull()).select(*group, "rank", "text").unionByName(cut_lineage(joined, "joined-blocks"))


def keyword_decisions(ranked: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group: ``prediction, confidence, evidence, reasoning, error``."""
    parts = segments(ranked, group)
    cleaned = clean_evidence(parts, "text")
    whole = F.col("cleaned_text")
    marker = C.EVIDENCE_END_MARKERS[-1]
    flags = K.rule_flags(F.col("low"))
    # Where the first block ends a sentence or the evidence, the quote is in it: no text is asked for again.
    enough = (F.col("rank") == 1) & (F.col("stops") | F.col("ends"))
    tested = cut_lineage(
        cleaned.withColumn("counts", X.cut_evidence(whole)).withColumn("low", F.lower("counts"))
        .select(
            *group, "rank", "counts", whole.contains(marker).alias("ends"), whole.contains(C.REPAIR_SENTENCE).alias("repair"),
            F.col("counts").rlike("[.!?]").alias("stops"), *[column.alias(name) for name, column in flags.items()],
        ).withColumn("quote", F.when(enough, X.first_sentence(F.col("counts")))).drop("counts"),
        "tested-blocks",
    )
    firsts = tested.groupBy(*group).agg(*[
        F.min(F.when(F.col(name), F.col("rank"))).alias(name) for name in ("ends", "repair", "stops", *flags)
    ], F.max("rank").alias("last"))
    upto = F.coalesce("ends", "last")
    seen = {name: F.coalesce(F.col(name) <= upto, F.lit(False)) for name in flags}
    quotes = tested.filter(F.col("quote").isNotNull()).select(*group, "quote")
    judged = cut_lineage(
        firsts.withColumn("verdict", K.verdict(seen, F.col("repair").isNotNull())).select(
            *group, "verdict.*", F.least(upto, F.coalesce("stops", "last")).alias("quoted")
        ).join(quotes, group, "left"), "judged-groups",
    )
    decided = judged.filter(F.col("label") != "unknown")
    told = decided.filter(F.col("quote").isNotNull()).select(*group, K.quotes(F.col("quote")).alias("evidence"))
    ranks = cut_lineage(decided.filter(F.col("quote").isNull()).select(
        *group, F.explode(F.sequence(F.lit(1).cast("long"), F.col("quoted").cast("long"))).alias("rank")
    ), "quoted-ranks")
    if not ranks.isEmpty():
        heads = (
            parts.withColumn("rank", F.col("rank").cast("long")).join(ranks, [*group, "rank"]).groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts"))
            .select(*group, F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"))
        )
        quote = X.first_sentence(X.cut_evidence(whole))
        told = told.unionByName(clean_evidence(heads, "text").select(*group, K.quotes(quote).alias("evidence")))
    label, confidence = F.col("label"), F.col("confidence")
    return judged.drop("quote").join(told, group, "left").select(
        *group, label.alias("prediction"), "confidence",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        K.reason(label, confidence).alias("reasoning"), F.lit(None).cast("string").alias("error"),
    )
