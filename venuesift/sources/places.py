"""Stored responses of a place search service, turned into evidence.

Two tables stand in for the service: searches ``(match_key, response, call_error)``,
keyed by the text query, and details ``(place_id, response, call_error)``. A response
is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import jsontext as J
from venuesift.functions.text import strip
from venuesift.session import cut_lineage
from venuesift.sources.catalog import EvidenceSource

_BAD_JSON = "response is not valid JSON"
_BAD_SHAPE = "response does not have the expected shape"
_NO_DETAILS = "no stored details for the place"


def _item(source_type: str, url: Column, snippet: Column, reliability: str) -> Column:
    return F.struct(
        F.lit(source_type).alias("source_type"), url.alias("url"),
        snippet.alias("snippet"), F.lit(reliability).alias("reliability"),
    )


def _is_text_or_missing(value: Column) -> Column:
    return value.isNull() | J.is_type(value, "VOID") | J.is_type(value, "STRING")


def search_misshapen(doc: Column) -> Column:
    """True for a search answer that is no object, or whose first candidate is none."""
    listed = J.variant_at(doc, "$.places")
    usable = J.is_type(listed, "ARRAY") & J.is_type(J.variant_at(listed, "$[0]"), "OBJECT")
    return ~J.is_type(doc, "OBJECT") | (~J.is_nothing(listed) & ~usable)


def details_misshapen(doc: Column, max_reviews: int = C.DEFAULT_MAX_REVIEWS) -> Column:
    """True for details that are no object, for reviews that are no list of objects, and for an
    address that is no text but would go into evidence."""
    listed = J.variant_at(doc, "$.reviews")
    first = F.coalesce(_listed_reviews(doc, max_reviews), F.array().cast("array<variant>"))
    usable = J.is_type(listed, "ARRAY") & F.forall(first, lambda review: J.is_type(review, "OBJECT"))
    maps_url, site = J.variant_at(doc, "$.googleMapsUri"), J.variant_at(doc, "$.websiteUri")
    editorial = J.localized_text(J.variant_at(doc, "$.editorialSummary")).isNotNull()
    shows_maps = (
        J.is_type(J.variant_at(doc, "$.outdoorSeating"), "BOOLEAN")
        | J.localized_text(J.variant_at(doc, "$.reviewSummary")).isNotNull()
        | (editorial & J.is_nothing(site)) | F.exists(first, lambda review: _review_text(review).isNotNull())
    )
    return (
        ~J.is_type(doc, "OBJECT") | (~J.is_nothing(listed) & ~usable)
        | (~_is_text_or_missing(maps_url) & shows_maps)
        | (~J.is_nothing(site) & ~J.is_type(site, "STRING") & editorial)
    )


def _listed_reviews(doc: Column, max_reviews: int) -> Column:
    return F.slice(F.try_variant_get(doc, "$.reviews", "array<variant>"), 1, max_reviews)


def _review_text(review: Column) -> Column:
    return F.coalesce(
        J.localized_text(J.variant_at(review, "$.text")), J.localized_text(J.variant_at(review, "$.originalText"))
    )


def place_candidate(searches: DataFrame) -> DataFrame:
    """Add ``place_id``: the id of the first candidate, or null."""
    first = F.try_variant_get(F.try_parse_json("response"), "$.places[0].id", "string")
    return searches.withColumn("place_id", F.nullif(first, F.lit("")))


def _text_at(doc: Column, field: str) -> Column:
    return F.try_variant_get(doc, f"$.{field}", "string")


def place_facts(doc: Column) -> Column:
    """Evidence of the place itself: seating flag, summary of reviews, editorial summary.

    Only a real boolean speaks about seating; a missing one says nothing.
    """
    flag = J.variant_at(doc, "$.outdoorSeating")
    seating = F.when(
        J.is_type(flag, "BOOLEAN"),
        F.when(F.try_variant_get(flag, "$", "boolean"), C.SEATING_LISTED)
        .otherwise(C.SEATING_NOT_LISTED),
    )
    maps_url = _text_at(doc, "googleMapsUri")
    site_or_maps = F.coalesce(F.nullif(_text_at(doc, "websiteUri"), F.lit("")), maps_url)
    reviews = J.localized_text(J.variant_at(doc, "$.reviewSummary"))
    editorial = J.localized_text(J.variant_at(doc, "$.editorialSummary"))
    return F.array_compact(F.array(
        F.when(seating.isNotNull(), _item("maps", maps_url, seating, "high")),
        F.when(reviews.isNotNull(), _item("maps", maps_url, reviews, "medium")),
        F.when(editorial.isNotNull(), _item("maps", site_or_maps, editorial, "medium")),
    ))


def place_reviews(doc: Column, max_reviews: int, max_chars: int) -> Column:
    """Evidence of the first reviews; one without text takes up its place all the same."""
    maps_url = _text_at(doc, "googleMapsUri")

    def snippet(review: Column) -> Column:
        return strip(F.substring(_review_text(review), 1, max_chars))

    first = F.coalesce(_listed_reviews(doc, max_reviews), F.array().cast("array<variant>"))
    texts = F.array_compact(F.transform(first, snippet))
    return F.transform(texts, lambda text: _item("review", maps_url, text, "low"))


def place_items(
    details: DataFrame,
    max_reviews: int = C.DEFAULT_MAX_REVIEWS,
    max_chars: int = C.DEFAULT_REVIEW_CHARS,
) -> DataFrame:
    """``(place_id, items, error)`` for each stored details response."""
    doc = F.col("_doc")
    parsed = details.withColumn("_doc", F.try_parse_json("response"))
    error = F.coalesce(
        F.col("call_error"), F.when(doc.isNull(), F.lit(_BAD_JSON)),
        F.when(details_misshapen(doc, max_reviews), F.lit(_BAD_SHAPE)),
    )
    return parsed.select(
        "place_id",
        F.when(error.isNull(), F.concat(place_facts(doc), place_reviews(doc, max_reviews, max_chars)))
        .alias("items"),
        error.alias("error"),
    )


def places_source(
    name: str,
    searches: DataFrame,
    details: DataFrame,
    max_reviews: int = C.DEFAULT_MAX_REVIEWS,
    max_chars: int = C.DEFAULT_REVIEW_CHARS,
) -> EvidenceSource:
    """Evidence source over stored responses; a details response is read once for each place.

    An answer that is not as expected fails the source for its key, with no evidence. Answers are taken apart once: what
    is in them is written, and evidence and errors both come from there.
    """
    doc = F.try_parse_json("response")
    search_error = F.coalesce(
        F.col("call_error"), F.when(doc.isNull(), F.lit(_BAD_JSON)),
        F.when(search_misshapen(doc), F.lit(_BAD_SHAPE)),
    )
    asked = cut_lineage(
        place_candidate(searches).select("match_key", "place_id", search_error.alias("error")), "place-searches"
    )
    failed = asked.filter(F.col("error").isNotNull())
    found = asked.filter(F.col("place_id").isNotNull() & F.col("error").isNull()).select("match_key", "place_id")
    items = cut_lineage(
        place_items(details, max_reviews, max_chars).withColumn("stored", F.lit(True)), "place-items"
    )
    joined = found.join(items, "place_id", "left").withColumn("error", F.when(F.col("stored").isNull(), F.lit(_NO_DETAILS)).otherwise(F.col("error")))

    rows = joined.select("match_key", F.posexplode("items").alias("item_pos", "item")).select(
        F.lit("place").alias("key_kind"), "match_key", F.lit(name).alias("source_name"),
        "item.source_type", F.col("item_pos").cast("long").alias("item_pos"),
        "item.url", "item.snippet", "item.reliability",
    )
    errors = (
        failed.select("match_key", "error")
        .unionByName(joined.filter(F.col("error").isNotNull()).select("match_key", "error"))
        .withColumn("key_kind", F.lit("place"))
    )
    return EvidenceSource(name, rows, errors)
