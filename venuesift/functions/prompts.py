"""Prompt texts; evidence and replies go in verbatim, never through a format string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuesift import contracts as C

_SCHEMA = (
    '{"label": "yes" or "no" or "unknown", "confidence": number from 0.0 to 1.0, '
    '"evidence": [quotes copied word for word], "reasoning": "short explanation"}'
)

SYSTEM_PROMPT = (
    "You label venues. Read the evidence and say if guests can sit outside there.\n"
    "Answer with one JSON object and nothing around it:\n"
    f"{_SCHEMA}\n"
    'Say "yes" or "no" only if the text settles it, and quote the words that do. '
    'Say "unknown" if the text is silent, thin or at odds with itself. '
    "Quote word for word. Add nothing that the text does not say. "
    "Keep confidence low unless the text leaves no doubt."
)

_USER_HEAD = "Does this venue have seats outside?\n\n" + C.EVIDENCE_MARKER
_USER_TAIL = C.EVIDENCE_END_MARKERS[0] + " that follows the schema and nothing else."

_REPAIR_HEAD = C.REPAIR_SENTENCE + ".\n\nYou answered:\n"
_REPAIR_MIDDLE = "\n\nThe evidence once more:\n"
_REPAIR_TAIL = "\n\nSend one JSON object of this form, with no fences or prose:\n" + _SCHEMA


def user_prompt(evidence: Column) -> Column:
    return F.concat(F.lit(_USER_HEAD), evidence, F.lit(_USER_TAIL))


def repair_prompt(reply: Column, evidence: Column) -> Column:
    return F.concat(
        F.lit(_REPAIR_HEAD), reply, F.lit(_REPAIR_MIDDLE), evidence, F.lit(_REPAIR_TAIL)
    )
