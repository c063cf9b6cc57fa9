"""Evidence sources: keyed entries, and the catalog of roles that a gather job reads."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import jsontext as J
from venuesift.functions import rules as R
from venuesift.functions.text import strip
from venuesift.session import cut_lineage

_ENTRY_SCHEMA = "key string, pos int, url string, snippet string"
_BAD_FILE = "catalog is not valid JSON"
# --- fixed values: JSON texts of a key that count as no entries --------------
_NO_ENTRIES = ("", "[]", "{}", "0", "0.0", "false")


@dataclass(frozen=True)
class EvidenceSource:
    """Rows of ``EVIDENCE_COLUMNS`` without ``source_ord``, and what went wrong at reading.

    ``errors`` holds failures for single keys. ``failure`` tells why the source as a whole
    did not work; every venue then gets this error and nothing of the rows.
    """

    name: str
    rows: DataFrame
    errors: DataFrame | None = None
    failure: str | None = None


def _read_text(spark: SparkSession, path: str, whole: bool) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=whole)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _object_text(value: Column) -> Column:
    """The text of the one JSON object in ``value``, null when there is anything else in it.

    As in ``jsontext.strict_json`` a digest at the end of an array around the text shows that the
    parser went through the whole of it; lists of texts also hold catalogs too large for a variant.
    """
    digest = F.sha2(value, 256)
    parts = F.from_json(F.concat(F.lit("["), value, F.lit(',"'), digest, F.lit('"]')), "array<string>")
    whole = (F.size(parts) == 2) & (F.element_at(parts, 2) == digest) & F.element_at(parts, 1).startswith("{")
    return F.when(whole, F.element_at(parts, 1))


def _objects(spark: SparkSession, path: str, one_object_per_line: bool) -> DataFrame | None:
    """``object``: the text of the JSON object of each file or line, null where it is none; None for a missing path."""
    text = _read_text(spark, path, whole=not one_object_per_line)
    if text is None:
        return None
    if one_object_per_line:
        text = text.filter(strip(F.col("value")) != "")
    elif text.isEmpty():  # Spark passes over files without a byte
        return spark.createDataFrame([(None,)], "object string")
    return text.select(_object_text(F.col("value")).alias("object"))


def is_broken(spark: SparkSession, path: str, one_object_per_line: bool = False) -> bool:
    """True when a file, or a line that is not blank, should hold one JSON object and does not."""
    objects = _objects(spark, path, one_object_per_line)
    return objects is not None and not objects.filter(F.col("object").isNull()).isEmpty()


def read_catalog(spark: SparkSession, path: str, one_object_per_line: bool = False) -> tuple[DataFrame, bool]:
    """The entries of ``read_entries``, and what ``is_broken`` says, from one reading of the files."""
    objects = _objects(spark, path, one_object_per_line)
    if objects is None:
        return spark.createDataFrame([], _ENTRY_SCHEMA), False
    written = cut_lineage(objects, "catalog-objects")
    return _entries(written), not written.filter(F.col("object").isNull()).isEmpty()


def read_entries(spark: SparkSession, path: str, one_object_per_line: bool = False) -> DataFrame:
    """Entries ``(key, pos, url, snippet)`` of JSON objects ``{key: [entry, ...]}``.

    A file holds one object, or one object on each line for catalogs of any size.
    A missing path is an empty source. An entry that is not an object with a text snippet,
    or a value that is not a list, gives an entry without snippet: the source has failed for
    that key, and other keys of the file are not affected. Text that is not one JSON object gives
    no entries; ``is_broken`` tells of it.
    """
    objects = _objects(spark, path, one_object_per_line)
    return spark.createDataFrame([], _ENTRY_SCHEMA) if objects is None else _entries(objects)


def _entries(objects: DataFrame) -> DataFrame:
    raw = F.col("raw")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    lists = (
        objects.select(F.explode(F.from_json("object", "map<string, string>")).alias("key", "raw"))
        .filter(raw.isNotNull() & ~raw.isin(*_NO_ENTRIES))
        .select("key", F.coalesce(listed, F.array(F.lit(None).cast("string"))).alias("entries"))
    )
    entries = lists.select("key", F.posexplode("entries").alias("pos", "entry")).withColumn(
        "entry", F.try_parse_json("entry")
    )
    url, snippet = J.variant_at(F.col("entry"), "$.url"), J.variant_at(F.col("entry"), "$.snippet")
    sound = J.is_type(snippet, "STRING") & (
        url.isNull() | J.is_type(url, "STRING") | J.is_type(url, "VOID")
    )
    return entries.select(
        "key", "pos",
        F.try_variant_get("entry", "$.url", "string").alias("url"),
        F.when(sound, F.try_variant_get("entry", "$.snippet", "string")).alias("snippet"),
    )


def static_source(name: str, source_type: str, entries: DataFrame) -> EvidenceSource:
    """Stamp entries with kind, source name and the default reliability of the kind."""
    kind = F.lit(source_type)
    rows = entries.select(
        F.lit("lookup").alias("key_kind"),
        F.col("key").alias("match_key"),
        F.lit(name).alias("source_name"),
        kind.alias("source_type"),
        F.col("pos").cast("long").alias("item_pos"),
        "url", "snippet",
        R.default_reliability(kind).alias("reliability"),
    )
    return EvidenceSource(name, rows)


def empty_source(spark: SparkSession, name: str, source_type: str) -> EvidenceSource:
    return static_source(name, source_type, spark.createDataFrame([], _ENTRY_SCHEMA))


def build_catalog(
    spark: SparkSession,
    *,
    website: EvidenceSource | None = None,
    search: EvidenceSource | None = None,
    reviews: EvidenceSource | None = None,
    maps: EvidenceSource | None = None,
    live: dict[str, EvidenceSource] | None = None,
    live_source: str | None = None,
) -> dict[str, EvidenceSource]:
    """Sources by role, in the order in which they are asked.

    A role that is not given is empty. ``live_source`` names one of ``live`` to take the
    place of maps; the other roles stay as they are.
    """
    given = {
        "website": website or empty_source(spark, "empty_website", "website"),
        "search": search or empty_source(spark, "static_search", "search"),
        "reviews": reviews or empty_source(spark, "static_reviews", "review"),
        "maps": maps or empty_source(spark, "static_maps", "maps"),
    }
    if live_source is not None:
        known = live or {}
        if live_source not in known:
            raise ValueError(f"unknown live source {live_source!r}; known: {sorted(known)}")
        given["maps"] = known[live_source]
    return {role: given[role] for role in C.ROLE_ORDER}


def static_catalog(
    spark: SparkSession,
    folder: str,
    *,
    one_object_per_line: bool = False,
    live: dict[str, EvidenceSource] | None = None,
    live_source: str | None = None,
) -> dict[str, EvidenceSource]:
    """Catalog over ``search.json``, ``reviews.json`` and ``maps.json`` of one folder."""
    def source(name: str, source_type: str, file: str) -> EvidenceSource:
        path = f"{folder}/{file}"
        entries, broken = read_catalog(spark, path, one_object_per_line)
        found = static_source(name, source_type, entries)
        return replace(found, failure=_BAD_FILE) if broken else found

    return build_catalog(
        spark,
        search=source("static_search", "search", "search.json"),
        reviews=source("static_reviews", "review", "reviews.json"),
        maps=source("static_maps", "maps", "maps.json"),
        live=live,
        live_source=live_source,
    )


def union_sources(catalog: dict[str, EvidenceSource]) -> DataFrame:
    """Evidence of all roles in one table; ``source_ord`` is the place in the catalog."""
    parts = [
        (source.rows.limit(0) if source.failure else source.rows)
        .withColumn("source_ord", F.lit(place)).select(*C.EVIDENCE_COLUMNS)
        for place, source in enumerate(catalog.values())
    ]
    return reduce(DataFrame.unionByName, parts)


def failed_sources(catalog: dict[str, EvidenceSource], venues: DataFrame) -> DataFrame | None:
    """An error for each venue and each source that failed as a whole, if any did."""
    failed = [
        F.struct(
            F.lit(place).alias("source_ord"), F.lit(source.name).alias("source_name"),
            F.lit(source.failure).alias("error"),
        )
        for place, source in enumerate(catalog.values()) if source.failure
    ]
    return venues.select("*", F.inline(F.array(*failed))) if failed else None


def union_errors(catalog: dict[str, EvidenceSource]) -> DataFrame | None:
    """Errors that sources reported when they were read, if any source reports them."""
    parts = [
        source.errors.withColumns({
            "source_ord": F.lit(place), "source_name": F.lit(source.name),
        }).select(*C.SOURCE_ERROR_COLUMNS)
        for place, source in enumerate(catalog.values())
        if source.errors is not None and not source.failure
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None
