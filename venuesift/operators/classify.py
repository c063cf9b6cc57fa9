"""Keyword rules that stand in for a model: deterministic, JVM-side only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import text as X


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True when any word occurs; a word that contains another one need not be looked for."""
    needed = [w for w in words if not any(other != w and other in w for other in words)]
    return reduce(or_, [text.contains(word) for word in needed])


def rule_flags(
    low: Column,
    outdoor_hints: tuple[str, ...] = C.OUTDOOR_HINTS,
    indoor_hints: tuple[str, ...] = C.INDOOR_HINTS,
    explicit_no: tuple[str, ...] = C.EXPLICIT_NO_PHRASES,
) -> dict[str, Column]:
    """What the rules ask of lower-case evidence. No phrase holds a line break, so that a flag
    of a text is the disjunction of the flags of its lines."""
    return {
        "outdoor": _any_of(low, outdoor_hints),
        "indoor": _any_of(low, indoor_hints),
        "explicit_no": _any_of(low, explicit_no),
        "exception": low.contains(C.DENIAL_EXCEPTION),
        "denial": _any_of(low, C.DENIAL_PHRASES),
        "denied_place": _any_of(low, C.DENIED_PLACE_HINTS),
        "conditional": low.contains(C.CONDITIONAL_HINT),
    }


def verdict(flag: dict[str, Column], repair: Column) -> Column:
    """Struct of label and confidence."""
    # --- fixed values: order of the rules, their labels and confidences -----
    return (
        F.when(repair, _verdict("unknown", 0.5))
        .when(flag["exception"] & flag["denial"] & flag["denied_place"], _verdict("unknown", 0.45))
        .when(flag["explicit_no"], _verdict("no", 0.91))
        .when(flag["indoor"] & ~flag["outdoor"], _verdict("no", 0.91))
        .when(flag["outdoor"] & ~flag["indoor"], _verdict("yes", 0.92))
        .when(flag["conditional"], _verdict("unknown", 0.55))
        .otherwise(_verdict("unknown", 0.35))
    )


def reason(label: Column, confidence: Column) -> Column:
    before, after = C.KEYWORD_REASON
    return F.when(confidence == 0.5, F.lit(C.REPAIR_REASON)).otherwise(
        F.concat(F.lit(before), label, F.lit(after))
    )


def quotes(quote: Column) -> Column:
    return F.when(quote != "", F.array(quote)).otherwise(F.array().cast("array<string>"))


def keyword_classify(
    df: DataFrame,
    text_col: str,
    out: str = "extraction",
    *,
    outdoor_hints: tuple[str, ...] = C.OUTDOOR_HINTS,
    indoor_hints: tuple[str, ...] = C.INDOOR_HINTS,
    explicit_no: tuple[str, ...] = C.EXPLICIT_NO_PHRASES,
    is_prompt: bool = False,
) -> DataFrame:
    """Add a struct of label, confidence, quotes and reason.

    ``text_col`` is the evidence itself, or with ``is_prompt`` a whole prompt.
    Both give the same answer for cleaned evidence.
    """
    whole = F.col(text_col)
    evidence = X.prompt_evidence(whole) if is_prompt else X.before_markers(whole)
    flag = rule_flags(F.col("_low"), outdoor_hints, indoor_hints, explicit_no)
    kept = {name: flag[name] for name in ("outdoor", "indoor")}  # each is asked for twice
    flag |= {name: F.col(f"_{name}") for name in kept}
    label, confidence = F.col("_verdict.label"), F.col("_verdict.confidence")
    return (
        df.withColumn("_cut", evidence)
        .withColumn("_evidence", X.strip_seldom(F.col("_cut")))
        .withColumn("_low", F.lower(F.col("_evidence")))
        .withColumns({f"_{name}": column for name, column in kept.items()})
        .withColumn("_verdict", verdict(flag, whole.contains(C.REPAIR_SENTENCE)))
        .withColumn("_sentence", F.when(label != "unknown", X.sentence_text(F.col("_evidence"))))
        .withColumn("_quote", X.strip_seldom(F.col("_sentence")))
        .withColumn(
            out,
            F.struct(
                label.alias("label"), confidence.alias("confidence"),
                quotes(F.col("_quote")).alias("evidence"), reason(label, confidence).alias("reasoning"),
            ),
        )
        .drop("_cut", "_evidence", "_low", "_outdoor", "_indoor", "_verdict", "_sentence", "_quote")
    )


def _verdict(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def keyword_extract(df: DataFrame) -> DataFrame:
    """Extraction stage for rows with ``cleaned_text``: fills the prediction columns."""
    classified = keyword_classify(df, "cleaned_text")
    ready = F.col("cleaned_text").isNotNull()
    return classified.withColumns({
        "prediction": F.when(ready, F.col("extraction.label")),
        "confidence": F.when(ready, F.col("extraction.confidence")),
        "evidence": F.when(ready, F.col("extraction.evidence"))
        .otherwise(F.array().cast("array<string>")),
        "reasoning": F.when(ready, F.col("extraction.reasoning")),
        "error": F.when(~ready, F.lit(C.ERROR_NO_CLEANED_TEXT)),
    }).drop("extraction")
