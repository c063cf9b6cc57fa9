"""Text expressions: one string column in, one string column out."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuesift import contracts as C

# Every character Python counts as white space; U+3000 is the last one.
SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _regex_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in chars) + "]"


_SPACE = _regex_class(SPACES)
# Classes of Latin-1 characters match several times faster, and few texts need more.
_LATIN_SPACE = _regex_class("".join(ch for ch in SPACES if ord(ch) < 0x100))
_WIDE_SPACE_RANGE = r"[\x{1680}-\x{3000}]"

# --- fixed values: patterns of lines that carry no evidence -----------------
_TAG = r"<[^>]++>"
_HEADER_LINE = rf"(?imdu)^{_SPACE}*+(?:MENU|OUR MENU|Navigation|Skip to content){_SPACE}*$"
_SEPARATOR_LINE = rf"(?md)^{_SPACE}*+[-=*_]{{3,}}+{_SPACE}*$"

# --- fixed values: entities decoded on the JVM; "amp" comes last ------------
COMMON_ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "#39": "'", "copy": "©", "reg": "®", "middot": "·",
    "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "amp": "&",
}
# An ampersand that may open an entity, other than one of those above.
_RARE_ENTITY = rf"&(?=[^\t\n\f <&;])(?!(?:{'|'.join(COMMON_ENTITIES)});)"


# --- fixed values: fenced blocks of a reply, and what ends a sentence -------
_FENCE = rf"(?isu)```(?:json)?{_SPACE}*\n?(.*?)\n?```"
_SENTENCE = r"[^.!?]+[.!?]?"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip_seldom(text: Column) -> Column:
    """``strip`` for a column whose texts seldom have white space at an end: one that begins and ends with a visible ASCII
    character, of which only the bytes at the ends are looked at, is passed over. Name the column, it is asked for thrice."""
    data, first, last = text.cast("binary"), F.lit(b"!"), F.lit(b"~")
    visible = F.substring(data, 1, 1).between(first, last) & F.substring(data, -1, 1).between(first, last)
    return F.when(visible, text).otherwise(strip(text))


def replace_seldom(text: Column, old: str, new: str) -> Column:
    """``replace`` for a column that seldom holds ``old``: looking for it is much cheaper. Name the column as well."""
    return F.when(text.contains(old), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def one_line_end(text: Column) -> Column:
    """Every line ends with a newline alone."""
    ends = text
    for line_end in ("\r\n", "\r"):
        ends = F.replace(ends, F.lit(line_end), F.lit("\n"))
    return F.when(text.contains("\r"), ends).otherwise(text)


def single_blanks(text: Column) -> Column:
    """Runs of blanks and tabs as one blank; a blank that stands alone is left as it is."""
    runs = text.contains("\t") | text.contains("  ")
    return F.when(runs, F.regexp_replace(text, r"\t[ \t]*+| [ \t]++", " ")).otherwise(text)


def trim_lines(text: Column) -> Column:
    """Trimmed lines, at most one empty line in a row, nothing empty at the ends; missing text is empty."""
    lines = F.array_join(F.transform(F.split(text, "\n", -1), strip_seldom), "\n")
    many = strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))
    return F.coalesce(F.when(text.contains("\n"), many).otherwise(strip_seldom(text)), F.lit(""))


def normalise_whitespace(text: Column) -> Column:
    """One newline style, single blanks, trimmed lines, at most one empty line in a row."""
    return trim_lines(single_blanks(one_line_end(text)))


def drop_tags(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, _TAG, " ")).otherwise(text)


def has_rare_entity(text: Column) -> Column:
    return text.contains("&") & text.rlike(_RARE_ENTITY)


def decode_common_entities(text: Column) -> Column:
    """Exact for text without rare entities: no replacement can form a new entity."""
    decoded = text
    for name, char in COMMON_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(char))
    return F.when(text.contains("&"), decoded).otherwise(text)


def decode_all_entities(text: Column) -> Column:
    """Arrow batches through the standard library's table of HTML entities."""

    # Defined here so that it ships to executors by value.
    def unescape(texts: pd.Series) -> pd.Series:
        import html

        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, T.StringType())(text)


def plain_blanks(text: Column) -> Column:
    return replace_seldom(text, "\u00a0", " ")


def drop_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _HEADER_LINE, ""), _SEPARATOR_LINE, "")


def drop_boilerplate_lines(text: Column) -> Column:
    """Remove header and separator lines from text whose entities are decoded."""
    return F.coalesce(drop_lines(plain_blanks(text)), F.lit(""))


def snippet_key(text: Column) -> Column:
    """Form under which two snippets count as the same."""
    low = F.lower(strip(text))
    return F.when(
        text.rlike(_WIDE_SPACE_RANGE), F.regexp_replace(low, f"{_SPACE}+", " ")
    ).otherwise(F.regexp_replace(low, f"{_LATIN_SPACE}+", " "))


def lookup_key(name: Column, city: Column) -> Column:
    return F.lower(F.concat_ws("|", name, city))


def place_query_text(name: Column, city: Column) -> Column:
    return F.concat_ws(", ", name, city)


def entity_slug(name: Column, city: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.concat_ws("-", name, city)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(C.EMPTY_SLUG))


def strip_fences(text: Column) -> Column:
    """Inside of the first fenced block, or the trimmed text when there is none."""
    text = strip(text)
    return F.when(text.rlike(_FENCE), strip(F.regexp_extract(text, _FENCE, 1))).otherwise(text)


def sentence_text(text: Column) -> Column:
    """Text up to the first full stop, or the head of text that is only punctuation; not yet trimmed."""
    return (
        F.when(text.rlike("[^.!?]"), F.regexp_extract(text, _SENTENCE, 0))
        .otherwise(F.substring(text, 1, 120))
    )


def first_sentence(text: Column) -> Column:
    return strip(sentence_text(text))


def before_markers(text: Column) -> Column:
    head = text
    for marker in C.EVIDENCE_END_MARKERS:
        head = F.substring_index(head, marker, 1)
    some = reduce(or_, [text.contains(marker) for marker in C.EVIDENCE_END_MARKERS])
    return F.when(some, head).otherwise(text)


def cut_evidence(text: Column) -> Column:
    """Evidence ends where the closing instruction of a prompt begins."""
    return strip(before_markers(text))


def prompt_evidence(prompt: Column) -> Column:
    """The evidence block of a prompt; a prompt without the marker is returned whole."""
    start = F.locate(C.EVIDENCE_MARKER, prompt)
    after = F.substring(prompt, start + F.lit(len(C.EVIDENCE_MARKER)), F.length(prompt))
    return F.when(start > 0, cut_evidence(after)).otherwise(strip(prompt))
