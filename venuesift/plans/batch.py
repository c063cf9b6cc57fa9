"""Batch job over records: clean, extract, validate, evaluate, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.operators.classify import keyword_extract
from venuesift.operators.cleaning import clean_evidence
from venuesift.operators.metrics import evaluate
from venuesift.operators.ordering import limit_records
from venuesift.operators.validation import validate_predictions
from venuesift.session import configure
from venuesift.sources import records as REC
from venuesift.sources import sinks

Extract = Callable[[DataFrame], DataFrame]


def _stages(seeds: DataFrame, threshold: float, extract: Extract) -> DataFrame:
    """Clean, extract, validate; rows without text (rejected ones) get no cleaned text either."""
    cleaned = clean_evidence(seeds, "raw_text").withColumn(
        "cleaned_text", F.when(F.col("raw_text").isNotNull(), F.col("cleaned_text"))
    )
    return validate_predictions(extract(cleaned), threshold)


def process_records(
    records: DataFrame,
    *,
    threshold: float = C.DEFAULT_THRESHOLD,
    limit: int | None = None,
    extract: Extract = keyword_extract,
    spread: int | None = None,
) -> DataFrame:
    """Working rows after all stages. With the keyword stage this is one scan, no shuffle.

    ``spread`` is for an input of a few files that cannot be split: its rows go to that many
    tasks by ``seq`` before the text stages.
    """
    configure(records.sparkSession)
    valid = REC.validate_records(records)
    if limit is not None:
        valid = limit_records(valid, limit)
    if spread is not None:
        valid = valid.repartition(spread, "seq")
    return _stages(REC.seed_state(valid), threshold, extract)


def run_job(
    records: DataFrame,
    out_dir: str,
    *,
    threshold: float = C.DEFAULT_THRESHOLD,
    limit: int | None = None,
    extract: Extract = keyword_extract,
    spread: int | None = None,
    csv: bool = False,
) -> DataFrame:
    """Write results, review queue, rejected rows and summary below ``out_dir``; return the summary.

    Rows are checked once. The valid go through the stages and are written as results without their texts,
    the rejected beside them as they came, in one pass over the input; all outputs are made from that
    table. A limit takes further passes to find its boundary, and one for the rejected rows.
    """
    spark = configure(records.sparkSession)
    checked = REC.check_records(records)
    valid = F.col("reject_reason").isNull()
    if limit is not None:
        checked = limit_records(checked.filter(valid), limit).unionByName(checked.filter(~valid))
    if spread is not None:
        checked = checked.repartition(spread, "seq")
    as_read = F.when(~valid, F.struct(*checked.columns))
    tagged = checked.withColumns({"rejected": as_read, "evidence_text": F.when(valid, F.col("evidence_text"))})
    state = _stages(REC.seed_state(tagged, keep=("rejected",)), threshold, extract)
    told = sinks.with_results(state).select("seq", *C.RESULT_COLUMNS, "expected_label", "rejected")
    told.write.mode("overwrite").parquet(f"{out_dir}/state")
    written = spark.read.parquet(f"{out_dir}/state")
    saved = written.filter(F.col("rejected").isNull()).drop("rejected")

    results, queue = sinks.in_order(saved), sinks.in_order(saved.filter("needs_review"))
    results.write.mode("overwrite").parquet(f"{out_dir}/results")
    queue.write.mode("overwrite").parquet(f"{out_dir}/review_queue")
    written.filter(F.col("rejected").isNotNull()).select("rejected.*").write.mode("overwrite").parquet(f"{out_dir}/rejected")
    if csv:
        sinks.write_csv(results, f"{out_dir}/results_csv")
        sinks.write_csv(queue, f"{out_dir}/review_queue_csv")
    evaluate(saved, threshold).write.mode("overwrite").parquet(f"{out_dir}/summary")
    return spark.read.parquet(f"{out_dir}/summary")
