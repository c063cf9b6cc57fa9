"""Text functions against fixed cases, and what must hold for many random texts."""

from __future__ import annotations

import json
import random
import re

import pytest

from venuesift.functions import prompts as P
from venuesift.functions import text as X
from venuesift.functions.jsontext import json_list
from venuesift.operators.cleaning import clean_evidence, strip_boilerplate
from pyspark.sql import functions as F


PIECES = [
    " ", "  ", "\t", "\n", "\r\n", "\r", "\n\n\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0",
    "\u2003", "\u2028", "\u3000", "MENU", "menu\n", "Our Menu", "NAVIGATION", "skip to content",
    "ſkip to content", "---", "===\n", "*_*-", "--", "<b>", "</p>", "<", ">", "<>", "<a\nb>", "&amp;",
    "&nbsp;", "&amp", "&eacute;", "&#233;", "&#x41;", "&#0;", "&notit;", "&unknown;", "&lt;p&gt;",
    "&amp;copy;", "&copy", "&", "& ", "&#39;", "&apos;", "&hellip;", "café", "日本", "word", "A.b!c?", "x",
]


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(3000)]


def test_normalised_text_has_its_form(out_of, random_texts):
    got = out_of(X.normalise_whitespace, random_texts)
    assert out_of(X.normalise_whitespace, got) == got
    for text, out in zip(random_texts, got):
        assert out.split() == text.split()
        assert not any(bad in out for bad in ("\r", "\t", "  ", "\n\n\n"))
        assert all(line == line.strip() for line in out.split("\n"))
        assert out == out.strip()


@pytest.mark.parametrize(("raw", "out"), [
    ("a\rb\r\nc", "a\nb\nc"), ("a\n \n\t\n\nb", "a\n\nb"), ("\u3000a \x1c b\x85", "a \x1c b"), ("x\u2028y", "x\u2028y"),
    ("\n\n a\t\tb \n", "a b"),
])
def test_normalise_more_cases(out_of, raw, out):
    assert out_of(X.normalise_whitespace, [raw]) == [out]


def test_normalise_cases(out_of):
    assert out_of(X.normalise_whitespace, ["  a   b  \r\n\r\n\n\n c ", "", " \n\t ", None]) == [
        "a b\n\nc", "", "", "",
    ]


def test_steps_that_are_passed_over_change_nothing(out_of, random_texts):
    ends = [f"{a}{b}{c}" for a in ("", *X.SPACES, "é") for b in ("", "x", "x y") for c in ("", *X.SPACES, "日", "~")]
    texts = [*random_texts, *ends, None]
    assert out_of(X.strip_seldom, texts) == out_of(X.strip, texts) == [t if t is None else t.strip() for t in texts]
    assert out_of(X.plain_blanks, texts) == [t if t is None else t.replace("\xa0", " ") for t in texts]
    assert out_of(X.one_line_end, texts) == [t if t is None else re.sub("\r\n?", "\n", t) for t in texts]
    assert out_of(X.single_blanks, texts) == [t if t is None else re.sub("[ \t]+", " ", t) for t in texts]
    marked = [*texts, "a\nReturn JSON b", "a\n\nReturn JSON b\nReturn JSON", "Return JSON a", "\nReturn JSON"]
    assert out_of(X.before_markers, marked) == [t if t is None else re.split("\n\n?Return JSON", t)[0] for t in marked]


def test_lists_with_every_control_character(spark):
    texts = ["plain", "", "é日", 'a"b', "a\\b", *(f"a{chr(code)}b" for code in range(0x20)), "\x01\t\"\\\x7f"]
    got = spark.createDataFrame([([text, None],) for text in texts], "v array<string>").select(json_list(F.col("v"))).collect()
    assert [row[0] for row in got] == [json.dumps([text, None], ensure_ascii=False) for text in texts]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


@pytest.mark.parametrize(("raw", "out"), [
    ("<b>x</b><i\nclass=a>y", " x  y"), ("a <> b", "a <> b"), ("a < b", "a < b"), ("1 < 2 <b> 3", "1   3"),
    ("&lt;p&gt; &amp;lt;", "<p> &lt;"), ("&eacute;&#233;&#x41;", "ééA"), ("&copy x &notit; &unknown;", "© x ¬it; &unknown;"),
    ("top\n MENU \nend", "top\nend"), ("menu", ""), ("Our Menu\nx", "\nx"), ("a\n\u017fkip to content\nb", "a\nb"),
    ("the menu", "the menu"), ("a\n=====\nb", "a\nb"), ("a\n--\nb", "a\n--\nb"), ("*_*-", ""), ("x ---", "x ---"), ("a&nbsp;b", "a b"),
])
def test_boilerplate_cases(spark, raw, out):
    got = strip_boilerplate(_frame(spark, [raw]), "t", "o").first().o
    assert got.split() == out.split() and got.replace("\n", "") == out.replace("\n", "")


def test_cleaned_text_has_its_form(spark, random_texts):
    rows = clean_evidence(_frame(spark, random_texts), "t", "o").orderBy("i").collect()
    for text, row in zip(random_texts, rows):
        assert row.o == row.o.strip() and "\xa0" not in row.o and "\n\n\n" not in row.o
        if "&" not in text:
            assert not re.search("<[^>]+>", row.o)
            assert "".join(row.o.split()) in "".join(text.split()) or "<" in text or re.search("(?i)menu|navig|kip to|[-=*_]{3}", text)


def test_clean_cases(spark):
    texts = ["<div> big   terrace </div>\n\n\nMENU\n\n---\n\n  open late ", "", None,
             "Soup &amp; bread on the&nbsp;roof", "&amp;copy; &lt;p&gt;"]
    rows = clean_evidence(_frame(spark, texts), "t", "o").orderBy("i").collect()
    assert [r.o for r in rows] == [
        "big terrace\n\nopen late", "", "", "Soup & bread on the roof", "&copy; <p>",
    ]


def test_common_entities_skip_python(spark):
    plain = ["a & b", "R&amp;D &copy; &middot;", "no sign", "&&;&<"]
    assert [r.o for r in _frame(spark, plain).select(X.has_rare_entity(F.col("t")).alias("o")).collect()] == [
        False] * 4


def test_snippet_key_folds_white_space_and_case(out_of, random_texts):
    got = out_of(X.snippet_key, random_texts)
    assert got == [" ".join(t.lower().split()) for t in random_texts]


def test_first_sentence(out_of):
    cases = {"One. Two.": "One.", "no stop": "no stop", "...": "...", "": "", ".  ": "", "!? Yes! No": "Yes!",
             "a" * 200: "a" * 200, "." * 130: "." * 120, "x\ny? z": "x\ny?"}
    assert out_of(X.first_sentence, list(cases)) == list(cases.values())


@pytest.mark.parametrize(("raw", "bare"), [
    ('{"a": 1}', '{"a": 1}'),
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('```\n{"a": 2}\n```', '{"a": 2}'),
    ('Look:\n```JSON\n{"a": 3}\n```\nand ```x```', '{"a": 3}'),
    ("  ``` open only", "``` open only"),
    ("``````", ""),
])
def test_strip_fences(out_of, raw, bare):
    assert out_of(X.strip_fences, [raw]) == [bare]


def test_slug_and_keys(spark):
    row = spark.createDataFrame([("Café  Río!", "São Paulo"), ("!!", "??")], "n string, c string").select(
        X.entity_slug(F.col("n"), F.col("c")).alias("slug"),
        X.lookup_key(F.col("n"), F.col("c")).alias("key"),
        X.place_query_text(F.col("n"), F.col("c")).alias("query"),
    ).collect()
    assert row[0].slug == "caf-r-o-s-o-paulo"
    assert row[0].key == "café  río!|são paulo"
    assert row[0].query == "Café  Río!, São Paulo"
    assert row[1].slug == "unknown-restaurant"


def test_prompts_hold_the_evidence_verbatim(out_of):
    texts = ["With {braces} and %s", "a\nReturn JSON b", "Evidence:\ninner"]
    prompts = out_of(P.user_prompt, texts)
    assert all(t in p for t, p in zip(texts, prompts))
    assert out_of(X.prompt_evidence, prompts) == ["With {braces} and %s", "a", "Evidence:\ninner"]
    assert out_of(X.prompt_evidence, [" no marker "]) == ["no marker"]
    for word in ("yes", "no", "unknown", "label", "confidence", "evidence", "reasoning", "JSON"):
        assert word in P.SYSTEM_PROMPT


def test_repair_prompt(spark):
    frame = spark.createDataFrame([("{bad}", "ev {x}")], "r string, e string")
    prompt = frame.select(P.repair_prompt(F.col("r"), F.col("e")).alias("p")).first().p
    assert prompt.index("You answered:") < prompt.index("{bad}") < prompt.index("The evidence once more:")
    assert "ev {x}" in prompt and prompt.startswith("Your previous response could not be parsed")


def test_json_list_matches_python(spark, random_texts):
    rng = random.Random(3)
    lists = [[rng.choice([*random_texts, None, '"', "\\", "\x07\x1f\x7f", "/"]) for _ in range(n % 4)]
             for n in range(300)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    got = [r.o for r in frame.select("i", json_list(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in lists]
