"""Gather job over requests: collect evidence from all sources, merge, decide, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import text as X
from venuesift.operators import merging as M
from venuesift.operators.cleaning import clean_evidence
from venuesift.operators.flat import keyword_decisions
from venuesift.operators.validation import validate_predictions
from venuesift.plans.batch import Extract
from venuesift.session import (
    configure,
    cut_lineage,
    new_table_path,
    remove_tables,
    write_table,
)
from venuesift.sources import requests as REQ
from venuesift.sources import sinks
from venuesift.sources.catalog import (
    EvidenceSource,
    failed_sources,
    union_errors,
    union_sources,
)

VENUE = ["name", "city"]


def venues(requests: DataFrame) -> DataFrame:
    """Each venue once, however many requests ask for it."""
    return requests.select(*VENUE).distinct()


EVIDENCE = [*VENUE, "source_ord", "item_pos", "source_name", "source_type", "url", "snippet", "reliability"]


@dataclass(frozen=True)
class Matched:
    """``links`` of venues to ``entries`` (with the texts) of sources that worked, and ``errors`` of the others.

    ``written`` is the table of all links.
    """

    links: DataFrame
    entries: DataFrame
    errors: DataFrame
    written: DataFrame

    def evidence(self) -> DataFrame:
        return M.fetch(self.links, self.entries).select(*EVIDENCE)

    def deduped(self) -> DataFrame:
        first = M.first_links(self.links, self.entries, VENUE)
        return M.fetch(first, self.entries, first).select(*EVIDENCE)

    def ranked(self) -> DataFrame:
        first = M.first_links(self.links, self.entries, VENUE)
        return M.fetch(M.rank_links(first, self.entries, VENUE), self.entries, first).select(*EVIDENCE, "rank")


def match(asked: DataFrame, catalog: dict[str, EvidenceSource]) -> Matched:
    """Links of each venue to what the sources have for it.

    The sources are read once: their entries are written, and links, evidence and errors come from that table.
    """
    entries = M.numbered_entries(union_sources(catalog))
    written = cut_lineage(M.gather_sources(asked, entries.drop("url", "snippet")), "links")
    links, errors = M.isolate_failures(written, VENUE)
    reported = union_errors(catalog)
    if reported is not None:
        errors = errors.unionByName(M.match_errors(asked, reported))
    failed = failed_sources(catalog, asked)
    return Matched(links, entries, errors if failed is None else errors.unionByName(failed), written)


def matched_evidence(
    asked: DataFrame, catalog: dict[str, EvidenceSource]
) -> tuple[DataFrame, DataFrame]:
    """Evidence of each venue from all sources, and the errors of its sources."""
    matched = match(asked, catalog)
    return matched.evidence(), matched.errors


def gather_state(
    asked: DataFrame, ranked: DataFrame, errors: DataFrame, threshold: float, extract: Extract | None
) -> DataFrame:
    """One decided row for each venue: prediction, errors, gate.

    The keyword rules decide from the ranked rows as they are, a venue of any size. With
    ``extract`` (a model) the combined text of a venue is put into one prompt; such rows have
    ``venue`` as a key, and venues without evidence do not reach the model.
    """
    counted = ranked.groupBy(*VENUE).agg(F.count(F.lit(1)).alias("found"))
    told = M.collect_errors(errors, VENUE)
    rows = M.no_evidence_gate(asked.join(counted, VENUE, "left"), F.col("found") > 0).drop("found")
    stopped = rows.filter("needs_review").withColumns({
        "prediction": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"),
        "evidence": F.array().cast("array<string>"), "reasoning": F.lit(None).cast("string"),
    })
    if extract is None:
        open_rows = keyword_decisions(ranked, VENUE)
    else:
        key = F.sha2(F.concat_ws("|", F.length("name"), "name", "city"), 256)
        texts = M.assemble_evidence(ranked, VENUE).select(
            *VENUE, key.alias("venue"), M.combine_evidence(F.col("items")).alias("raw_text"),
            F.lit(None).cast("string").alias("error"),
        )
        open_rows = extract(clean_evidence(texts, "raw_text")).drop("venue", "raw_text", "cleaned_text")
    decided = validate_predictions(
        open_rows.withColumns({"validation_status": F.lit(None).cast("string"), "needs_review": F.lit(False)}), threshold
    )
    return stopped.unionByName(decided).join(told, VENUE, "left").withColumn(
        "gather_errors", F.coalesce("gather_errors", F.array().cast("array<string>"))
    )


def decided_venues(
    asked: DataFrame,
    catalog: dict[str, EvidenceSource],
    threshold: float,
    extract: Extract | None,
    evidence_path: str,
    venues_path: str,
) -> DataFrame:
    """Write the ranked evidence of the asked venues, and from it one decided row for each."""
    spark = configure(asked.sparkSession)
    matched = match(asked, catalog)
    write_table(matched.ranked(), evidence_path, "zstd")
    remove_tables(matched.entries)
    state = gather_state(asked, spark.read.parquet(evidence_path), matched.errors, threshold, extract)
    write_table(sinks.lists_as_json(state, ["evidence", "gather_errors"]), venues_path)
    remove_tables(matched.written)
    return spark.read.parquet(venues_path)


def attach_requests(requests: DataFrame, decided: DataFrame, ranked: DataFrame) -> DataFrame:
    """Result rows with ``seq``: the decision of its venue and its evidence for each request.

    The lists of a venue are made once, then joined to the requests that ask for it.
    """
    lists = M.assemble_evidence(ranked, VENUE).withColumns(M.provenance(F.col("items"))).drop("items")
    listed = sinks.lists_as_json(decided.join(lists, VENUE, "left"), sinks.PROVENANCE_LISTS)
    asked = requests.select("seq", *VENUE).withColumn(
        "restaurant_id", X.entity_slug(F.col("name"), F.col("city"))
    )
    return asked.join(listed, VENUE)


def process_requests(
    requests: DataFrame,
    catalog: dict[str, EvidenceSource],
    *,
    threshold: float = C.DEFAULT_THRESHOLD,
    extract: Extract | None = None,
) -> DataFrame:
    """Result rows of all valid requests, with ``seq``, which must be unique in ``requests``."""
    spark = requests.sparkSession
    valid = REQ.validate_requests(requests)
    evidence_path = new_table_path(spark, "evidence")
    decided = decided_venues(
        venues(valid), catalog, threshold, extract, evidence_path, new_table_path(spark, "venues")
    )
    return attach_requests(valid, decided, spark.read.parquet(evidence_path))


def run_gather_job(
    requests: DataFrame,
    catalog: dict[str, EvidenceSource],
    out_dir: str,
    *,
    threshold: float = C.DEFAULT_THRESHOLD,
    extract: Extract | None = None,
    csv: bool = False,
) -> DataFrame:
    """Write the tables of a job below ``out_dir``; return the results, in no order (``job_results`` sorts them).

    ``evidence`` holds ranked rows, ``venues`` a decision for each venue, ``requests`` who asked for
    what, ``rejected`` the requests that cannot be answered. Results and review queue are these
    tables joined; only an export as CSV writes the lists of a venue for each request. A sort would
    shuffle these lists once for each request, so only what is read in order is sorted.
    """
    spark = requests.sparkSession
    checked = REQ.check_requests(requests)
    write_table(checked.filter(F.col("reject_reason").isNotNull()), f"{out_dir}/rejected")
    valid = checked.filter(F.col("reject_reason").isNull()).select("seq", *VENUE)
    write_table(valid, f"{out_dir}/requests")
    decided_venues(
        venues(spark.read.parquet(f"{out_dir}/requests")), catalog, threshold, extract,
        f"{out_dir}/evidence", f"{out_dir}/venues",
    )
    if csv:
        for name, rows in (("results", job_results(spark, out_dir)), ("review_queue", job_review_queue(spark, out_dir))):
            sinks.write_csv(rows, f"{out_dir}/{name}_csv")
    return _joined(spark, out_dir).select(*C.GATHER_COLUMNS)


def _joined(spark: SparkSession, out_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{out_dir}/{name}") for name in ("requests", "venues", "evidence"))
    return attach_requests(*tables)


def job_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """The results of a job that has run, in request order."""
    return sinks.gather_results_rows(_joined(spark, out_dir))


def job_review_queue(spark: SparkSession, out_dir: str, in_order: bool = True) -> DataFrame:
    """Results for people to look at, in request order unless that is not needed: a sort shuffles the lists of each row."""
    rows = _joined(spark, out_dir)
    return sinks.gather_review_queue(rows) if in_order else rows.filter("needs_review").select(*C.GATHER_COLUMNS)
