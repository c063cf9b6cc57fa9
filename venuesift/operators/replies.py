"""Model replies: parsing, schema check, one repair attempt, and the model hook.

Replies are a table ``(<key>, attempt, reply, call_error)``. Whatever produced
it, a stored table or the hook below, ``extract_with_repair`` reads it the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuesift import contracts as C
from venuesift.functions import jsontext as J
from venuesift.functions import prompts as P
from venuesift.functions import text as X
from venuesift.operators.calls import Retry, in_order
from venuesift.session import cut_lineage, new_table_path

_NUMBER_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _confidence(value: Column) -> Column:
    """A number, a boolean, or text that spells a number; null for anything else."""
    spelled = J.variant_at(value, "$.confidence")
    as_double = F.try_variant_get(value, "$.confidence", "double")
    text = F.try_variant_get(value, "$.confidence", "string")
    return F.when(~J.is_type(spelled, "STRING") | text.rlike(_NUMBER_TEXT), as_double)


def parse_response(df: DataFrame, reply_col: str, out: str = "parsed") -> DataFrame:
    """Add ``out``: is_json, schema_ok and the extraction struct (null unless the schema holds)."""
    value = F.col("_value")
    quotes = F.try_variant_get(value, "$.evidence", "array<variant>")
    fields = F.struct(
        F.try_variant_get(value, "$.label", "string").alias("label"),
        _confidence(value).alias("confidence"),
        F.transform(quotes, lambda q: F.try_variant_get(q, "$", "string")).alias("evidence"),
        F.try_variant_get(value, "$.reasoning", "string").alias("reasoning"),
    )
    listed = J.is_type(J.variant_at(value, "$.evidence"), "ARRAY")
    all_text = F.forall(quotes, lambda q: J.is_type(q, "STRING"))
    schema_ok = F.coalesce(
        J.is_type(J.variant_at(value, "$.label"), "STRING")
        & F.col("_fields.label").isin(*C.LABELS)
        & F.col("_fields.confidence").between(0.0, 1.0)
        & listed
        & all_text
        & J.is_type(J.variant_at(value, "$.reasoning"), "STRING"),
        F.lit(False),
    )
    return (
        df.withColumn("_value", J.strict_json(X.strip_fences(F.col(reply_col))))
        .withColumn("_fields", fields)
        .withColumn("_ok", schema_ok)
        .withColumn(
            out,
            F.struct(
                value.isNotNull().alias("is_json"),
                F.col("_ok").alias("schema_ok"),
                F.when(F.col("_ok"), F.col("_fields")).alias("extraction"),
            ),
        )
        .drop("_value", "_fields", "_ok")
    )


def extract_with_repair(df: DataFrame, replies: DataFrame, key: str = "seq") -> DataFrame:
    """Fill the prediction columns of ``df`` from its replies.

    Attempt 1 counts if it parses. An error of the call ends the matter. Attempt 2
    counts only when attempt 1 came back and did not parse.
    """
    parsed = parse_response(replies, "reply")
    attempts = parsed.groupBy(key).agg(*[
        F.max_by(
            F.struct("parsed", "call_error"), F.when(F.col("attempt") == n, F.col("attempt"))
        ).alias(f"_try{n}")
        for n in (1, 2)
    ])
    joined = df.join(attempts, key, "left")

    ready = F.col("cleaned_text").isNotNull()
    first_failed = F.col("_try1.call_error").isNotNull()
    first_ok = ~first_failed & F.coalesce(F.col("_try1.parsed.schema_ok"), F.lit(False))
    second_failed = F.col("_try2.call_error").isNotNull()
    second_ok = ~second_failed & F.coalesce(F.col("_try2.parsed.schema_ok"), F.lit(False))
    why = F.when(
        F.coalesce(F.col("_try2.parsed.is_json"), F.lit(False)), "reply does not match the schema"
    ).otherwise("reply is not valid JSON")

    picked = (
        F.when(ready & first_ok, F.col("_try1.parsed.extraction"))
        .when(ready & ~first_failed & second_ok, F.col("_try2.parsed.extraction"))
    )
    error = (
        F.when(~ready, F.lit(C.ERROR_NO_CLEANED_TEXT))
        .when(first_failed, F.col("_try1.call_error"))
        .when(first_ok, F.lit(None).cast("string"))
        .when(second_failed, F.col("_try2.call_error"))
        .when(~second_ok, F.concat(F.lit(C.ERROR_REPAIR_FAILED), why))
    )
    return (
        joined.withColumn("_picked", picked)
        .withColumns({
            "prediction": F.col("_picked.label"),
            "confidence": F.col("_picked.confidence"),
            "evidence": F.coalesce(F.col("_picked.evidence"), F.array().cast("array<string>")),
            "reasoning": F.col("_picked.reasoning"),
            "error": error,
        })
        .drop("_picked", "_try1", "_try2")
    )


Complete = Callable[[str, str], str]

#: Calls after which replies are kept, where the caller gives no number of waves.
WAVE_CALLS = 100_000


def call_model(
    prompts: DataFrame, make_complete: Callable[[], Complete], attempt: int, key: str = "seq",
    in_flight: int = 1, retry: Retry = Retry(),  # noqa: B008
) -> DataFrame:
    """Call ``complete(system, user)`` for each row of ``(<key>, prompt)``.

    The client is built once for each partition and has up to ``in_flight`` calls at once, whose replies keep the
    order of the rows; ``retry`` says when a call is tried again. The last exception of a call becomes the
    ``call_error`` of its row and does not touch the others.
    """
    system = P.SYSTEM_PROMPT

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_complete()
        for batch in batches:
            asked = ((system, prompt) for prompt in batch["prompt"])
            told = list(in_order(complete, asked, in_flight, retry))
            yield pd.DataFrame({
                key: batch[key], "attempt": attempt, "reply": [reply for reply, _ in told],
                "call_error": [error for _, error in told],
            })

    schema = T.StructType([
        prompts.schema[key],
        T.StructField("attempt", T.IntegerType()),
        T.StructField("reply", T.StringType()),
        T.StructField("call_error", T.StringType()),
    ])
    return prompts.select(key, "prompt").mapInPandas(answer, schema)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _call_missing(
    prompts: DataFrame, make_complete: Callable[[], Complete], attempt: int, key: str, path: str,
    partitions: int | None, waves: int | None, in_flight: int, retry: Retry,
) -> DataFrame:
    """The replies of one attempt; keys that ``path`` already has are not asked again."""
    spark = prompts.sparkSession
    folder = f"{path}/{attempt}"
    schema = call_model(prompts, make_complete, attempt, key).schema
    have = _stored(spark, folder, schema).select(key)
    missing = prompts.join(have, key, "left_anti")
    if waves is None:
        waves = max(1, -(-missing.count() // WAVE_CALLS))
    for wave in range(waves):
        asked = missing.filter(F.pmod(F.xxhash64(key), F.lit(waves)) == wave) if waves > 1 else missing
        if partitions is not None:
            asked = asked.repartition(partitions, key)
        call_model(asked, make_complete, attempt, key, in_flight, retry).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def collect_replies(
    df: DataFrame,
    make_complete: Callable[[], Complete],
    key: str = "seq",
    path: str | None = None,
    partitions: int | None = None,
    waves: int | None = None,
    in_flight: int = 1,
    retry: Retry = Retry(),  # noqa: B008
) -> DataFrame:
    """Reply table of both passes for the rows of ``df`` that have cleaned text.

    The table at ``path`` is keyed by (key, attempt). A job that is started again with the same
    ``path`` only asks for what is not there; calls are kept after each of ``waves`` parts of the
    keys, or after about ``WAVE_CALLS`` of them if no number is given. As many tasks call as ``df`` has partitions that run, or as
    ``partitions`` says, each with ``in_flight`` calls at once.
    """
    path = path or new_table_path(df.sparkSession, "replies")
    ready = df.filter(F.col("cleaned_text").isNotNull()).select(key, "cleaned_text")
    prompts = ready.select(key, P.user_prompt(F.col("cleaned_text")).alias("prompt"))
    first = _call_missing(prompts, make_complete, 1, key, path, partitions, waves, in_flight, retry)
    unparsed = (
        parse_response(first.filter(F.col("call_error").isNull()), "reply")
        .filter(~F.col("parsed.schema_ok"))
        .select(key, "reply")
    )
    again = ready.join(unparsed, key).select(
        key, P.repair_prompt(F.col("reply"), F.col("cleaned_text")).alias("prompt")
    )
    second = _call_missing(again, make_complete, 2, key, path, partitions, waves, in_flight, retry)
    return first.unionByName(second)


def hook_extract(make_complete: Callable[[], Complete], key: str = "seq", **options):
    """Extraction stage that calls a model; takes the place of the keyword stage.

    The cleaned rows are written first: both passes and the final join read them, and all
    must see the same keys. ``options`` are those of ``collect_replies``.
    """

    def extract(df: DataFrame) -> DataFrame:
        rows = cut_lineage(df, "cleaned")
        return extract_with_repair(rows, collect_replies(rows, make_complete, key, **options), key)

    return extract
