"""Chat formatting with a template that is only known by what it renders.

For each turn the prefix of the conversation up to it is rendered and compared with the
rendering before it. If the earlier one is its beginning, the rest is the span of the turn;
if not, the template has rewritten history. Inside the span of a turn that counts for
the loss, two probes with one strange character each in place of the text show where the text
begins and how much follows it.

Defined results: null text and null role are empty; turns are ordered by number (null first), then
role, then text, so that ties and repeated rows have one order; rows without a conversation
id form a conversation of their own; an empty table gives no rows. Other columns are not
read. One conversation is one output row, so it is held by one task; nothing else is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuesift.llm.common import batched, rows_of, small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_OPEN, _CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_PLAIN = {escape: text for text, escape in _ESCAPES.items()} | {"\\n": "\n"}
_ESCAPED = re.compile(r"\\[\\htn]")
_TURN = re.compile(r"### ([^\n]*)\n(.*?)</turn>\n", re.DOTALL)
_PROBES = ("\uf8f0", "\uf8f1")

SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.large_string()), ("turn_ends", pa.list_(pa.int64())),
    ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())),
    ("rewritten_at", pa.int64()),
])
_SPARK_SCHEMA = (
    "conv_id long, formatted string, turn_ends array<long>, loss_starts array<long>, "
    "loss_ends array<long>, rewritten_at long"
)


def escape(text: str) -> str:
    """The text without control strings; a backslash marks what was replaced."""
    return _CONTROL.sub(lambda found: _ESCAPES[found[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: _PLAIN[found[0]], text)


def turn_template(turns: list[Turn]) -> str:
    """The template used here: a header line with the role, the text, and an end mark."""
    return "".join(
        f"{_OPEN}{escape(role).replace('\n', '\\n')}\n{escape(text)}{_CLOSE}" for role, text in turns
    )


def read_turns(formatted: str) -> list[Turn]:
    """The turns that ``turn_template`` has written."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@dataclass
class Rendered:
    """A rendering, the end of each turn in it, the spans under the loss, and the first turn
    (from 0) at which the template changed what it had written before, if any."""

    text: str = ""
    ends: list[int] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    rewritten_at: int | None = None


def render(turns: list[Turn], template: Template, loss_roles: frozenset[str]) -> Rendered:
    """Render successive prefixes, each of them whole, which takes the square of a conversation's length.

    After a rewrite the spans name no fixed text, so none are given.
    """
    shorter = template([])
    out = Rendered(text=shorter)
    for k, (role, _) in enumerate(turns):
        longer = template(turns[:k + 1])
        if not longer.startswith(shorter):
            return Rendered(text=template(turns), rewritten_at=k)
        if role in loss_roles:
            one, other = (template([*turns[:k], (role, probe)]) for probe in _PROBES)
            start = _first_difference(one, other, len(shorter))
            out.loss.append((start, len(longer) - (len(one) - start - 1)))
        out.ends.append(len(longer))
        shorter = longer
    out.text = shorter
    return out


def _first_difference(one: str, other: str, start: int) -> int:
    while start < len(one) and one[start] == other[start]:
        start += 1
    return start


def format_chats(
    chats: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: the formatted text and its spans, in code points.

    Turns reach a task in order and go through it as a stream of batches.
    """
    roles = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, rows in groupby(rows_of(batches), key=lambda row: row[0]):
                done = render([(role, text) for _, _, role, text in rows], template, roles)
                starts, ends = zip(*done.loss, strict=True) if done.loss else ((), ())
                yield conv_id, done.text, done.ends, starts, ends, done.rewritten_at

        return batched(each(), SCHEMA)

    small_batches(chats.sparkSession)
    turns = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, _SPARK_SCHEMA)


DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("rewritten_at", pa.int64()),
])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of ``format_chats`` holds, read from its texts and spans alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, text, starts, ends, rewritten_at in rows_of(batches):
                turns, spoken, chars = hashlib.sha256(), hashlib.sha256(), 0
                found = read_turns(text)
                for role, said in found:
                    turns.update(f"{role}\n{said}\n".encode())
                for start, end in zip(starts, ends, strict=True):
                    said = unescape(text[start:end])
                    spoken.update(said.encode())
                    chars += len(said)
                yield conv_id, len(found), turns.hexdigest(), chars, spoken.hexdigest(), len(text), rewritten_at

        return batched(each(), DIGEST_SCHEMA)

    columns = formatted.select("conv_id", "formatted", "loss_starts", "loss_ends", "rewritten_at")
    return columns.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, rewritten_at long",
    )
