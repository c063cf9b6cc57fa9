"""Match evidence to requests, then deduplicate, rank and combine it.

Entries of the sources are written once, with a number. Matching, failures, deduplication and ranks go by links: rows
with that number and what decides, but without texts. The texts cross once, in ``fetch``, for the links that are left.

``group`` is the list of columns that identify what evidence is merged for. The
gather job uses (name, city), so requests that ask for the same venue share the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R
from venuesift.functions import text as X
from venuesift.operators.flat import block_text
from venuesift.operators.ordering import rank_rows
from venuesift.session import cut_lineage

MATCH = ["key_kind", "match_key"]


#: Number of a written entry, and the beginning of its snippet key.
ENTRY, HEAD = "entry", "key_head"
HEAD_CHARS = 48
DIGEST = "snippet_digest"
#: Sets of 64 entries that are broadcast at most.
MOST_SETS = 1 << 21


def numbered_entries(rows: DataFrame) -> DataFrame:
    """Write entries of sources with a number each, a digest of the form under which snippets count as the same (null
    without a snippet), and the head of that form."""
    key = F.col("_key")
    told = rows.withColumn("_key", X.snippet_key(F.col("snippet"))).withColumns({
        DIGEST: F.unhex(F.sha2(key, 256)), HEAD: F.substring(key, 1, HEAD_CHARS), ENTRY: F.monotonically_increasing_id(),
    })
    return cut_lineage(told.drop("_key"), "entries", "zstd")


def wanted(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries whose number is in ``kept``, without a shuffle of them; or all, if the numbers are too many for that.

    Numbers count up in each file of entries, so sets of 64 of them, one long each, are few enough to be broadcast.
    """
    mask, own = F.expr(f"shiftleft(1L, cast({ENTRY} & 63 as int))"), F.shiftright(ENTRY, 6).alias("_set")
    sets = cut_lineage(kept.groupBy(own).agg(F.bit_or(mask).alias("_mask")), "wanted")
    if sets.count() > MOST_SETS:
        return entries
    met = entries.join(F.broadcast(sets), F.shiftright(ENTRY, 6) == F.col("_set"))
    return met.filter(F.col("_mask").bitwiseAND(mask) != 0).drop("_set", "_mask")


def fetch(links: DataFrame, entries: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Links with the url and the snippet of their entries: the one step in which texts cross.

    ``kept`` is a written table of (at least) the entries that the links name. Give it where they are
    few of all: no text of others crosses then.
    """
    texts = entries.select(ENTRY, "url", "snippet")
    return (texts if kept is None else wanted(texts, kept)).join(links.hint("shuffle_hash"), ENTRY)


def isolate_failures(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links to sources that worked, and one error for each group and source that did not.

    An entry without a snippet spoils all that its source has for that group; other
    groups and other sources are untouched.
    """
    errors = (
        rows.filter(F.col(DIGEST).isNull()).select(*group, "source_ord", "source_name").distinct()
        .withColumn("error", F.lit(C.ERROR_MISSING_SNIPPET))
    )
    keys = [*group, "source_ord"]
    return rows.join(errors.select(*keys), keys, "left_anti"), errors


def match_keys(units: DataFrame) -> DataFrame:
    """The texts under which the sources may know a venue, one row for each kind."""
    name, city = F.col("name"), F.col("city")
    kinds = F.array(
        F.struct(F.lit("lookup").alias("key_kind"), X.lookup_key(name, city).alias("match_key")),
        F.struct(F.lit("place").alias("key_kind"), X.place_query_text(name, city).alias("match_key")),
    )
    return units.select("name", "city", F.inline(kinds))


def gather_sources(units: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of all sources for each venue, in one equi-join; misses give no rows.

    A key with very many rows is split by Spark's adaptive skew join.
    """
    return rows.join(match_keys(units), MATCH).drop(*MATCH)


def match_errors(units: DataFrame, errors: DataFrame) -> DataFrame:
    return errors.join(match_keys(units), MATCH).drop(*MATCH)


def first_links(links: DataFrame, entries: DataFrame, group: list[str]) -> DataFrame:
    """Of equal snippets in a group the first in source order, then item order, stays.

    Links that share even the place are cut to the smallest row, which only their texts can tell.
    """
    own = ["source_name", "source_type", "reliability", HEAD, ENTRY]
    keys = [*group, DIGEST, "source_ord", "item_pos"]
    placed = links.groupBy(*keys).agg(F.min(F.struct(*own)).alias("_row"), F.count(F.lit(1)).alias("_same"))
    first = cut_lineage(
        placed.groupBy(*group, DIGEST).agg(F.min(F.struct("source_ord", "item_pos", "_row", "_same")).alias("_first"))
        .select(*group, DIGEST, "_first.*").select(*keys, "_row.*", "_same"), "first-links",
    )
    single, twins = first.filter("_same = 1").drop("_same"), first.filter("_same > 1").select(*keys)
    if twins.isEmpty():
        return single
    whole = ["source_name", "source_type", "url", "snippet", "reliability", HEAD, ENTRY]
    met = cut_lineage(links.join(twins, keys, "left_semi"), "twin-links")
    told = fetch(met, entries, met).groupBy(*keys).agg(F.min(F.struct(*whole)).alias("_row"))
    return single.unionByName(cut_lineage(told.select(*keys, "_row.*").select(*single.columns), "told-twins"))


def rank_links(first: DataFrame, entries: DataFrame, group: list[str]) -> DataFrame:
    """Add ``rank`` from 1 to links of different snippets.

    Heads of snippet keys order most links; the whole key is fetched for those alone that agree in all before it.
    """
    graded = first.withColumns({
        "reliability_rank": R.rank(F.col("reliability"), C.RELIABILITY_RANK),
        "type_rank": R.rank(F.col("source_type"), C.SOURCE_TYPE_RANK),
    })
    same = [*group, "reliability_rank", "type_rank", "source_name", HEAD]
    long = F.length(HEAD) == HEAD_CHARS
    many = graded.filter(long).groupBy(*same).agg(F.count(F.lit(1)).alias("_same")).filter("_same > 1").drop("_same")
    tied = cut_lineage(graded.filter(long).join(many, same, "left_semi").select(*group, ENTRY), "tied-links")
    order = [F.col(name) for name in same[len(group):]]
    if not tied.isEmpty():
        whole = fetch(tied, entries, tied).select(*group, ENTRY, X.snippet_key(F.col("snippet")).alias("_key"))
        graded, order = graded.join(whole, [*group, ENTRY], "left"), [*order, F.col("_key")]
    return rank_rows(graded, group, order).drop("reliability_rank", "type_rank", "_key")


def dedup_evidence(evidence: DataFrame, group: list[str]) -> DataFrame:
    """Of equal snippets in a group the first in source order, then item order, stays.

    The first is found by digests and places alone, which a hash aggregation combines before its
    shuffle; the texts then cross once, in the join that fetches the rows of the first. Places
    are unique in a group; rows that share one are cut to the smallest. (A job does the same
    without texts: ``first_links``.)
    """
    place = ["source_ord", "item_pos"]
    keyed = evidence.withColumn(DIGEST, F.sha2(X.snippet_key(F.col("snippet")), 256))
    first = keyed.groupBy(*group, DIGEST).agg(F.min(F.struct(*place)).alias("_first"))
    keys = [*group, DIGEST, *place]
    met = keyed.join(first.select(*group, DIGEST, "_first.*"), keys, "left_semi")
    others = [c for c in evidence.columns if c not in keys]
    return met.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*group, *place, "_row.*")


def rank_order() -> list[Column]:
    """Reliability, kind of source, source name, snippet key."""
    return [
        R.rank(F.col("reliability"), C.RELIABILITY_RANK).alias("reliability_rank"),
        R.rank(F.col("source_type"), C.SOURCE_TYPE_RANK).alias("type_rank"),
        F.col("source_name"), X.snippet_key(F.col("snippet")).alias("key"),
    ]


def rank_evidence(deduped: DataFrame, group: list[str]) -> DataFrame:
    """Flat form: a ``rank`` column from 1, safe for groups of any size."""
    return rank_rows(deduped, group, rank_order())


def assemble_evidence(deduped: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group with its evidence as a ranked array: the form of an export."""
    order = [F.col("rank")] if "rank" in deduped.columns else rank_order()
    own = ["source_type", "url", "snippet", "reliability"] + ["source_name"] * ("rank" in deduped.columns)
    item = F.struct(*order, *own)
    ranked = deduped.groupBy(*group).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return ranked.withColumn(
        "items",
        F.transform("items", lambda i: F.struct(
            i.source_type.alias("source_type"), i.source_name.alias("source_name"),
            i.url.alias("url"), i.snippet.alias("snippet"), i.reliability.alias("reliability"),
        )),
    )


def collect_errors(errors: DataFrame, group: list[str]) -> DataFrame:
    """``source: error`` texts in source order; there is at most one for each source."""
    message = F.concat(F.col("source_name"), F.lit(": "), F.col("error"))
    told = errors.filter(F.col("error") != "")
    return told.groupBy(*group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("source_ord", message.alias("message")))),
            lambda e: e.message,
        ).alias("gather_errors")
    )


def combine_evidence(items: Column) -> Column:
    """Blocks of ``[kind] url`` and snippet with an empty line between them."""
    blocks = F.transform(items, lambda i: block_text(i.source_type, i.url, i.snippet))
    return F.array_join(blocks, "\n\n")


def provenance(items: Column) -> dict[str, Column]:
    """Snippets, urls (missing ones kept) and kinds, all in rank order."""
    return {
        "source_evidence_snippets": F.transform(items, lambda i: i.snippet),
        "source_urls": F.transform(items, lambda i: i.url),
        "source_types": F.transform(items, lambda i: i.source_type),
    }


def no_evidence_gate(df: DataFrame, found: Column) -> DataFrame:
    """Set error, status and review flag of rows for which nothing was ``found``."""
    empty = ~F.coalesce(found, F.lit(False))
    return df.withColumns({
        "error": F.when(empty, F.lit(C.ERROR_NO_EVIDENCE)),
        "validation_status": F.when(empty, F.lit("failed")),
        "needs_review": empty,
    })
