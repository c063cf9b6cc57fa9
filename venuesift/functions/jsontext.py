"""JSON expressions: variants read with care for types, and lists written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuesift.functions import text as X

# --- fixed values: escapes of JSON text -------------------------------------
_ESCAPES = {
    "\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t",
    "\f": "\\f", "\b": "\\b",
}


# Levels read by path, and the least number of characters one more level takes.
_PLAIN_LEVELS = 5
_LEVEL_CHARS = len('{"text":')


def _quoted(value: Column) -> Column:
    """Most texts hold nothing to escape, and of the others most no control character without an escape of its own."""
    usual = value
    for char, escape in _ESCAPES.items():
        usual = F.replace(usual, F.lit(char), F.lit(escape))
    escaped = usual
    for code in range(0x20):
        if chr(code) not in _ESCAPES:
            escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    escaped = F.when(value.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), escaped).otherwise(usual)
    value = F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(value)
    return F.concat(F.lit('"'), value, F.lit('"'))


def json_list(values: Column) -> Column:
    """A list of strings as JSON text; a missing item is written as null."""
    items = F.transform(values, lambda item: F.coalesce(_quoted(item), F.lit("null")))
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ", "), F.lit("")), F.lit("]"))


def is_type(value: Column, prefix: str) -> Column:
    """True when the variant holds this type, false also for a missing variant."""
    return F.coalesce(F.schema_of_variant(value).startswith(prefix), F.lit(False))


def variant_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def is_nothing(value: Column) -> Column:
    """True for a missing value, null, false, zero, and an empty text, list or object."""
    number = ~is_type(value, "STRING") & (F.try_variant_get(value, "$", "double") == 0)
    return (
        value.isNull() | is_type(value, "VOID") | F.coalesce(number, F.lit(False))
        | (is_type(value, "STRING") & (F.try_variant_get(value, "$", "string") == ""))
        | (is_type(value, "ARRAY") & variant_at(value, "$[0]").isNull())
        | (is_type(value, "OBJECT<>"))
    )


def strict_json(text: Column) -> Column:
    """The one JSON value the text holds, or null when there is anything else in it.

    Spark's parser stops after the first complete value. The text is therefore
    wrapped in an array that ends with a digest of the text. A text cannot
    contain its own digest, so an array of two items that ends with it proves
    that the parser went through the whole text and found one value.
    """
    digest = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = (
        (F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 2)
        & (F.try_variant_get(wrapped, "$[1]", "string") == digest)
    )
    return F.when(whole, variant_at(wrapped, "$[0]"))


def localized_text(value: Column) -> Column:
    """A string, or an object whose ``text`` holds one, however many objects deep.

    What is still an object after a few levels is followed step by step; its length bounds the
    number of steps, because each level is spelled out in it.
    """
    path = "$"
    found = []
    for _ in range(_PLAIN_LEVELS):
        found.append(_own_text(variant_at(value, path)))
        path += ".text"
    deep = variant_at(value, path)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(F.to_json(deep)) / _LEVEL_CHARS).cast("int")))
    inner = F.aggregate(
        steps, deep,
        lambda level, _: F.when(is_type(level, "OBJECT"), variant_at(level, "$.text")).otherwise(level),
    )
    found.append(F.when(is_type(deep, "OBJECT"), _own_text(inner)).otherwise(_own_text(deep)))
    return F.coalesce(*found)


def _own_text(level: Column) -> Column:
    stripped = X.strip(F.try_variant_get(level, "$", "string"))
    return F.when(is_type(level, "STRING"), F.nullif(stripped, F.lit("")))
