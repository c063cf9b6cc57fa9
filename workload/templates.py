"""Short texts that exercise every rule; rows pick one by their key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCES = [
    "Sit on the <b>patio</b> under the vines.",
    "Rooftop &amp; terrace tables, first come first served!",
    "Two halls, both indoors; we do not offer a yard.",
    "Jazz cellar: a basement, and it has no windows.",
    "Before May we do not have outdoor service, then the patio opens on request.",
    "Grill nights are outdoor, weather permitting, else inside the barn.",
    "Fresh bread daily.",
    "MENU\n\n-----\nSoup &copy; 2020\n***\n  navigation \nThe deck is open.",
    "<p>Al fresco lunch&nbsp;served</p>\r\n<div>Skip to content</div>\r\n\r\n\r\n\t Ask  for the garden. ",
    "Fish &amp;amp; chips &lt;b&gt; by the sidewalk",
    "Cr&egrave;me br&ucirc;l&eacute;e on the terrace &#8211; yes",
    "An indoor hall and an outdoor yard.",
    "Quiet room.\nReturn JSON of the patio.",
    "...!?",
    "Your previous response could not be parsed. Patio.",
    "Weather permitting, we open late.",
]

REPLIES_FIRST = [
    '{"label": "yes", "confidence": 0.9, "evidence": ["{n} has a patio"], "reasoning": "clear"}',
    '```json\n{"label": "no", "confidence": 0.8, "evidence": ["{n}"], "reasoning": "in"}\n```',
    'See below:\n```\n{"label": "unknown", "confidence": 1, "evidence": [], "reasoning": ""}\n```\nDone.',
    '{"label": "yes", "confidence": 0.9, "evidence": ["{n}"], "reasoning": "x"} thanks',
    '{"label": "maybe", "confidence": 0.9, "evidence": ["{n}"], "reasoning": "x"}',
    '{"label": "yes", "confidence": 1.5, "evidence": ["{n}"], "reasoning": "x"}',
    '{"label": "yes", "confidence": 0.9, "evidence": ["{n}", 1], "reasoning": "x"}',
    None,
]
REPLIES_SECOND = [
    '{"label": "unknown", "confidence": 0.5, "evidence": [], "reasoning": "{n}"}',
    "no json at all",
    None,
    '{"label": "no", "confidence": "0.75", "evidence": ["{n}"], "reasoning": "as text", "more": 1}',
    '[{"label": "no"}]',
]

SEARCHES = [
    '{"places": [{"id": "p{k}"}, {"id": "other"}]}',
    '{"places": [{"id": "p{k}"}]}',
    '{"places": [{"name": "{n}"}, {"id": "p{k}"}]}',
    '{"places": []}',
    '{"places": [{"id": "p{k}"}]}',
    "<html>busy</html>",
    None,
    '[{"id": "p{k}"}]',
    '{"places": [7, {"id": "p{k}"}]}',
    '{"places": {"id": "p{k}"}}',
    '{"places": 0}',
]
# Places in the lists of answers that are not as expected.
MISSHAPEN_SEARCHES = [7, 8, 9]
DETAILS = [
    '{"googleMapsUri": "https://maps.test/{k}", "websiteUri": "https://site.test/{k}", '
    '"outdoorSeating": true, "reviewSummary": {"text": {"text": " Guests of {n} like the terrace. "}}, '
    '"editorialSummary": {"text": "A house by the river."}, "reviews": [{"text": {"text": "Nice deck."}}, '
    '{"originalText": {"text": "Klein aber fein."}}, {"text": {"text": "  "}}, {"text": "Past the limit"}]}',
    '{"googleMapsUri": "https://maps.test/{k}", "websiteUri": "", "outdoorSeating": false, '
    '"editorialSummary": "Plain words about {n}"}',
    '{"googleMapsUri": "https://maps.test/{k}", "outdoorSeating": "true", "reviews": []}',
    "{}",
    '{"reviews": [{"text": "' + "Long words about the patio. " * 14 + '"}, {"text": 5}]}',
    '{"reviewSummary": 5, "editorialSummary": {"text": {"text": {"text": "deep"}}}, "outdoorSeating": null}',
    "not json",
    '[1]',
    '{"googleMapsUri": "https://maps.test/{k}", "outdoorSeating": true, "reviews": {"text": "{n}"}}',
    '{"outdoorSeating": false, "reviews": ["Plain words about {n}"]}',
    '{"googleMapsUri": 5, "outdoorSeating": true}',
    '{"googleMapsUri": "https://maps.test/{k}", "websiteUri": 5, "editorialSummary": "About {n}"}',
    '{"googleMapsUri": 5, "websiteUri": "https://site.test/{k}", "editorialSummary": "About {n}", "reviews": null}',
]
MISSHAPEN_DETAILS = [7, 8, 9, 10, 11]

CALL_ERROR = "service unavailable"


def pick(texts: list[str | None], key: Column) -> Column:
    """Text of the row's key."""
    choices = F.array(*[F.lit(text) for text in texts])
    return F.element_at(choices, (F.pmod(key, F.lit(len(texts))) + 1).cast("int"))


def fill(text: Column, key: Column, name: Column) -> Column:
    text = F.replace(text, F.lit("{k}"), key.cast("string"))
    return F.replace(text, F.lit("{n}"), name)
