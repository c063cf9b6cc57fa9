"""Data contracts: column orders, label sets, rank tables and fixed texts.

Everything in this module is a fixed value. The words, orders, thresholds and
output texts decide the results, so they are stated here as they are, once.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: labels, statuses, thresholds -----------------------------
LABELS = ("yes", "no", "unknown")
DEFAULT_THRESHOLD = 0.6
DEFAULT_MAX_REVIEWS = 3
DEFAULT_REVIEW_CHARS = 300

# --- fixed values: cells read as missing in a records CSV -------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: evidence ranks and defaults ------------------------------
RELIABILITY_RANK = {"high": 0, "medium": 1, "low": 2}
SOURCE_TYPE_RANK = {"website": 0, "maps": 1, "search": 2, "review": 3}
DEFAULT_RELIABILITY = {
    "website": "high",
    "search": "medium",
    "maps": "medium",
    "review": "low",
}
ROLE_ORDER = ("website", "search", "reviews", "maps")

# --- fixed values: output column orders -------------------------------------
RESULT_COLUMNS = [
    "restaurant_id", "name", "prediction", "confidence", "evidence",
    "reasoning", "validation_status", "needs_review", "is_correct", "error",
]
GATHER_COLUMNS = [
    "restaurant_id", "name", "city", "prediction", "confidence", "evidence",
    "source_evidence_snippets", "source_urls", "source_types", "reasoning",
    "validation_status", "needs_review", "gather_errors", "error",
]

# --- fixed values: keyword rules --------------------------------------------
OUTDOOR_HINTS = (
    "patio", "terrace", "outdoor", "deck", "rooftop", "al fresco",
    "garden terrace", "sidewalk",
)
INDOOR_HINTS = (
    "indoor", "indoors", "inside", "basement", "no windows", "no exterior",
    "do not offer", "no outdoor", "strictly indoors",
)
EXPLICIT_NO_PHRASES = (
    "do not offer", "do not have outdoor", "no patio", "no outdoor",
    "not offer patio",
)
DENIAL_PHRASES = ("do not have outdoor", "no outdoor")
DENIED_PLACE_HINTS = ("patio", "sidewalk")
DENIAL_EXCEPTION = "opens on"
CONDITIONAL_HINT = "weather permitting"

# --- fixed values: markers inside prompts -----------------------------------
EVIDENCE_MARKER = "Evidence:\n"
EVIDENCE_END_MARKERS = ("\n\nReturn JSON", "\nReturn JSON")
REPAIR_SENTENCE = "Your previous response could not be parsed"

# --- fixed values: texts that appear in result cells ------------------------
KEYWORD_REASON = ("Dry-run heuristic classified the evidence as '", "'.")
REPAIR_REASON = "Dry-run repair fallback returned unknown."
ERROR_NO_CLEANED_TEXT = "Missing cleaned_text: run preprocessing first."
ERROR_REPAIR_FAILED = "Failed to parse extraction JSON after repair retry: "
ERROR_NO_EVIDENCE = "No evidence gathered from any source"
ERROR_MISSING_SNIPPET = "'snippet'"
SEATING_LISTED = "Google Places lists outdoor seating as available."
SEATING_NOT_LISTED = "Google Places does not list outdoor seating as available."
EMPTY_SLUG = "unknown-restaurant"

# --- schemas ----------------------------------------------------------------
RECORD_FIELDS = ("id", "name", "evidence_text", "expected_label")

EXTRACTION_TYPE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
])

# One evidence row of a source, before it is matched to a request. ``key_kind`` says
# which text of a request ``match_key`` is compared with: "lookup" or "place".
EVIDENCE_COLUMNS = [
    "key_kind", "match_key", "source_ord", "source_name", "source_type",
    "item_pos", "url", "snippet", "reliability",
]
SOURCE_ERROR_COLUMNS = ["key_kind", "match_key", "source_ord", "source_name", "error"]
