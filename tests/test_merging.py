"""Sources, merge, joins of skewed keys, decisions from flat rows."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from venuesift.operators import merging as M
from venuesift.operators.classify import keyword_extract
from venuesift.operators.cleaning import clean_evidence
from venuesift.operators.flat import keyword_decisions
from venuesift.operators.ordering import rank_rows
from venuesift.plans.gathering import match, matched_evidence
from venuesift.sources import catalog as CAT
from venuesift.sources import places as PL

ITEM = ("g string, source_ord int, item_pos long, source_type string, source_name string, "
        "url string, snippet string, reliability string")


def items(spark, rows):
    return spark.createDataFrame([("g", o, p, t, n, u, s, r) for o, p, t, n, u, s, r in rows], ITEM)


def ranked(spark, rows):
    return M.assemble_evidence(M.dedup_evidence(items(spark, rows), ["g"]), ["g"]).first()["items"]


def test_equal_snippets_keep_the_first_in_source_order(spark):
    got = ranked(spark, [
        (3, 0, "maps", "m", "u3", "The  Deck\nis open", "medium"),
        (2, 5, "review", "r", "u2", " the deck is OPEN ", "low"),
        (2, 4, "review", "r", "u1", "The deck is open", "low"),
    ])
    assert [(i.source_type, i.url, i.snippet) for i in got] == [("review", "u1", "The deck is open")]


def test_rank_order(spark):
    got = ranked(spark, [
        (0, 0, "review", "z", None, "r low", "low"), (1, 0, "search", "b", None, "s med", "medium"),
        (1, 1, "maps", "b", None, "m med", "medium"), (2, 0, "website", "c", None, "w med", "medium"),
        (2, 1, "review", "a", None, "r high", "high"), (3, 0, "search", "a", None, "s2 med", "medium"),
        (3, 1, "search", "a", None, "B med", "medium"), (4, 0, "search", "a", None, "a med", "medium"),
    ])
    assert [i.snippet for i in got] == [
        "r high", "w med", "m med", "a med", "B med", "s2 med", "s med", "r low"]


def test_combined_text_and_provenance(spark):
    rows = [(0, 0, "maps", "m", "http://m", "One.", "high"), (1, 0, "search", "s", "", "Two.", "medium"),
            (2, 0, "review", "r", None, "Three.", "low")]
    frame = M.assemble_evidence(M.dedup_evidence(items(spark, rows), ["g"]), ["g"])
    row = frame.select(M.combine_evidence(F.col("items")).alias("t"),
                       *[c.alias(n) for n, c in M.provenance(F.col("items")).items()]).first()
    assert row.t == "[maps] http://m\nOne.\n\n[search]\nTwo.\n\n[review]\nThree."
    assert row.source_urls == ["http://m", "", None] and row.source_types == ["maps", "search", "review"]
    assert row.source_evidence_snippets == ["One.", "Two.", "Three."]


def test_unknown_rank_is_an_error(spark):
    with pytest.raises(Exception, match="no rank for"):
        ranked(spark, [(0, 0, "radio", "m", None, "x", "high")])


def test_errors_in_source_order(spark):
    errors = spark.createDataFrame(
        [("g", 2, "late", "gone"), ("g", 1, "first", "lost key"), ("g", 0, "quiet", ""), ("h", 0, "quiet", "")],
        "g string, source_ord int, source_name string, error string")
    rows = {r.g: r.gather_errors for r in M.collect_errors(errors, ["g"]).collect()}
    assert rows == {"g": ["first: lost key", "late: gone"]}


def test_flat_rank_equals_array_rank_for_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randint(0, 3), n,
             rng.choice(["maps", "search"]), rng.choice("xyz"), None, f"text {rng.randint(0, 4000)}",
             rng.choice(["high", "medium", "low"])) for n in range(6000)]
    deduped = M.dedup_evidence(spark.createDataFrame(rows, ITEM), ["g"]).repartition(7).cache()
    flat = M.rank_evidence(deduped, ["g"]).collect()
    arrays = {r.g: [i.snippet for i in r["items"]] for r in M.assemble_evidence(deduped, ["g"]).collect()}
    assert len(flat) == deduped.count()
    for group, snippets in arrays.items():
        ours = sorted((r.rank, r.snippet) for r in flat if r.g == group)
        assert ours == list(enumerate(snippets, start=1))


def test_rank_splits_a_group_over_partitions(spark):
    frame = spark.range(50_000).select(F.lit("one").alias("g"), F.reverse(F.lpad(F.col("id"), 6, "0")).alias("o"))
    ranks = rank_rows(frame, ["g"], ["o"])
    got = [r["rank"] for r in ranks.orderBy("o").collect()]
    assert got == list(range(1, 50_001))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_adaptive_joins_split_many_hot_keys(spark, how):
    """More hot keys than any list would hold, with thresholds lowered to the size of a test."""
    keep = {name: spark.conf.get(name) for name in SKEW}
    try:
        for name, value in SKEW.items():
            spark.conf.set(name, value)
        big = spark.range(400_000).select(
            F.when(F.col("id") % 3 > 0, F.col("id") % 300).otherwise(F.col("id")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"))
        small = spark.range(0, 600).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        joined = big.join(small, "k", how)
        count = joined.count()
        plain = big.join(F.broadcast(small), "k", how).count()
        assert count == plain
    finally:
        for name, value in keep.items():
            spark.conf.set(name, value)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
}


# --- decisions from flat rows -----------------------------------------------

BLOCK = "g string, rank long, source_type string, url string, snippet string"
BITS = [
    "patio", "no", " ", "patio", "We do not have outdoor seats", "opens on", "sidewalk", "inside", "basement", "deck", ".", "!",
    "weather permitting", "<", ">", "<b>", "<>", "<i", "MENU", "\n", "\n---\n", "Return JSON", "\nReturn JSON now", "&lt;b&gt;",
    "&amp;", "&nbsp;", "&eacute;", "\u00a0", "Your previous response could not be parsed", "bread", "a < b", "x > y", "no <b",
]


def combined_answer(spark, rows):
    """The rules on the whole text of each group."""
    ranked = spark.createDataFrame(rows, BLOCK)
    items = F.array_sort(F.collect_list(F.struct("rank", "source_type", "url", "snippet")))
    whole = ranked.groupBy("g").agg(items.alias("items")).select(
        "g", M.combine_evidence(F.col("items")).alias("raw"), F.lit(None).cast("string").alias("error"))
    answer = keyword_extract(clean_evidence(whole, "raw"))
    return {r.g: (r.prediction, r.confidence, r.evidence, r.reasoning) for r in answer.collect()}


def flat_answer(spark, rows):
    flat = keyword_decisions(spark.createDataFrame(rows, BLOCK), ["g"])
    return {r.g: (r.prediction, r.confidence, r.evidence, r.reasoning) for r in flat.collect()}


def random_blocks(seed, groups, most):
    rng = random.Random(seed)
    return [
        (f"g{g}", n + 1, rng.choice(["maps", "search", "review"]), rng.choice([None, "", "https://x.test/1", "u"]),
         "".join(rng.choices(BITS, k=rng.randrange(0, 7))))
        for g in range(groups) for n in range(rng.randrange(1, most))
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flat_decision_equals_combined_decision(spark, seed):
    rows = random_blocks(seed, 400, 9)
    assert flat_answer(spark, rows) == combined_answer(spark, rows)


def test_flat_decision_of_a_hot_group(spark, monkeypatch):
    """One group with most of the evidence, and tags that reach over many blocks and stretches."""
    monkeypatch.setattr("venuesift.operators.flat._STRETCH", 16)
    rng = random.Random(4)
    hot = [("hot", n + 1, "review", None, "bread " * rng.randrange(9)) for n in range(2000)]
    for at, text in ((5, "we love it <b"), (40, "and then"), (90, "style> no <i"), (130, "x"), (700, "> patio"), (1200, "a terrace. <")):
        hot[at] = (*hot[at][:4], text)
    rows = hot + random_blocks(9, 20, 40)
    assert flat_answer(spark, rows) == combined_answer(spark, rows)


# --- sources ----------------------------------------------------------------

UNITS = [("The Quay", "Oslo"), ("THE QUAY", "oslo"), ("Nowhere", "Rome")]


def text_shuffles(frame):
    """Shuffles that a snippet goes through, in the plan before it runs."""
    plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum("Exchange" in part.splitlines()[0] and "snippet#" in part for part in plan.split("\n\n") if part.startswith("("))


def entry_source(spark, rows):
    frame = spark.createDataFrame([(k, p, u, s) for k, p, u, s in rows], "key string, pos int, url string, snippet string")
    return {"reviews": CAT.static_source("static_reviews", "review", frame)}


def test_texts_cross_once_however_much_is_decided(spark):
    rows = [("the quay|oslo", n, None, f"text {n % 7}") for n in range(20)] + [("nowhere|rome", 0, None, None)]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = match(units(spark), CAT.build_catalog(spark, **entry_source(spark, rows)))
        frames = [matched.evidence(), matched.deduped(), matched.ranked()]
        assert [text_shuffles(frame) for frame in frames] == [1, 1, 1]
        assert [frame.count() for frame in frames] == [40, 14, 14]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_only_texts_that_are_asked_for_cross(spark, monkeypatch):
    """Two links that tie fetch their own texts and no others; copies that dedup dropped stay where they are."""
    begins = "a beginning of more than forty-eight characters, the same "
    rows = [("the quay|oslo", n, None, f"text {n % 7}") for n in range(300)]
    rows += [("the quay|oslo", 300 + n, None, begins + end) for n, end in enumerate("ab")]
    matched = match(units(spark), CAT.build_catalog(spark, **entry_source(spark, rows)))
    wanted, seen = M.wanted, []

    def counted(entries, kept):
        got = wanted(entries, kept)
        seen.append(sorted(r.entry for r in got.collect()) == sorted({r.entry for r in kept.collect()}) and got.count())
        return got

    monkeypatch.setattr(M, "wanted", counted)
    assert matched.ranked().count() == 18 and seen == [2, 9]
    monkeypatch.setattr(M, "MOST_SETS", 0)
    assert matched.ranked().count() == 18


@pytest.mark.parametrize("prefix", ["", "same words " * 9])
def test_links_rank_and_dedup_as_rows_with_texts_do(spark, prefix):
    """Keys that begin alike, rows that share even their place, venues that share a key."""
    rng = random.Random(8)
    rows = [(rng.choice(["the quay|oslo", "nowhere|rome"]), rng.randrange(30), rng.choice([None, "", "u", "v"]),
             prefix + rng.choice(["", " ", "\n"]) + rng.choice(["A", "a", "b", "é", "z", ""]) + rng.choice("xyz")) for _ in range(300)]
    matched = match(units(spark), CAT.build_catalog(spark, **entry_source(spark, rows)))
    plain = M.dedup_evidence(matched.evidence(), ["name", "city"])
    wanted = M.rank_evidence(plain, ["name", "city"])
    columns = sorted(wanted.columns)
    assert Counter(matched.ranked().select(columns).collect()) == Counter(wanted.select(columns).collect())
    assert Counter(matched.deduped().select(plain.columns).collect()) == Counter(plain.collect())


def units(spark):
    return spark.createDataFrame(UNITS, "name string, city string")


def folder(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1), encoding="utf-8")
    return str(tmp_path)


def gathered(spark, catalog):
    evidence, errors = matched_evidence(units(spark), catalog)
    return evidence.orderBy("name", "source_ord", "item_pos").collect(), errors.collect()


def test_static_catalog(spark, tmp_path):
    path = folder(
        tmp_path,
        search={"the quay|oslo": [{"url": "u", "snippet": "Seats on the pier"}, {"snippet": "Second"}],
                "Nowhere|Rome": [{"snippet": "mixed-case keys never match"}]},
        reviews={"the quay|oslo": [{"snippet": "Nice"}]},
    )
    found, errors = gathered(spark, CAT.static_catalog(spark, path))
    assert [(r.name, r.source_name, r.source_type, r.reliability, r.url, r.snippet) for r in found] == [
        (name, source, kind, level, url, text)
        for name in ("THE QUAY", "The Quay")
        for source, kind, level, url, text in (
            ("static_search", "search", "medium", "u", "Seats on the pier"),
            ("static_search", "search", "medium", None, "Second"),
            ("static_reviews", "review", "low", None, "Nice"))
    ]
    assert errors == []


def test_an_entry_without_snippet_spoils_its_source_only(spark, tmp_path):
    path = folder(
        tmp_path,
        search={"the quay|oslo": [{"snippet": "fine"}, {"url": "u"}], "nowhere|rome": [{"snippet": "kept"}]},
        maps={"the quay|oslo": [{"snippet": "on the map"}]},
    )
    found, errors = gathered(spark, CAT.static_catalog(spark, path))
    assert sorted((r.name, r.snippet) for r in found) == [
        ("Nowhere", "kept"), ("THE QUAY", "on the map"), ("The Quay", "on the map")]
    assert sorted((r.name, r.source_name, r.error) for r in errors) == [
        ("THE QUAY", "static_search", "'snippet'"), ("The Quay", "static_search", "'snippet'")]


def test_malformed_keys_do_not_spoil_a_file(spark, tmp_path):
    good = {"url": None, "snippet": "fine [\"x\"] é"}
    path = folder(tmp_path, search={
        "ok": [good, {"snippet": ""}], "text": "str", "object": {"url": "u"}, "number": [good, 5], "item": ["s"],
        "null snippet": [{"snippet": None}], "number snippet": [{"snippet": 5}], "bad url": [{"url": 5, "snippet": "s"}],
        "nothing": None, "empty": [], "zero": 0,
    })
    got = {}
    for row in CAT.read_entries(spark, f"{path}/search.json").orderBy("key", "pos").collect():
        got.setdefault(row.key, []).append(row.snippet)
    assert got == {
        "ok": ["fine [\"x\"] é", ""], "text": [None], "object": [None], "number": ["fine [\"x\"] é", None],
        "item": [None], "null snippet": [None], "number snippet": [None], "bad url": [None],
    }
    (tmp_path / "broken.json").write_text("{not json", encoding="utf-8")
    assert CAT.read_entries(spark, f"{path}/broken.json").count() == 0


@pytest.mark.parametrize("text", ["{not json", '{"a": []} junk', "[1]", '"text"', "", '{"a": []}\n{"b": []}'])
def test_files_that_are_not_one_object_fail(spark, tmp_path, text):
    (tmp_path / "search.json").write_text(text, encoding="utf-8")
    assert CAT.is_broken(spark, str(tmp_path / "search.json"))
    assert CAT.read_entries(spark, str(tmp_path / "search.json")).count() == 0


def test_a_bad_line_fails_its_source(spark, tmp_path):
    good = '{"the quay|oslo": [{"snippet": "Pier"}]}'
    for name, lines in {"search": [good, "", " "], "reviews": [good, "junk"], "maps": [good + " more", good]}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(lines), encoding="utf-8")
    found, errors = gathered(spark, CAT.static_catalog(spark, str(tmp_path), one_object_per_line=True))
    assert {r.source_name for r in found} == {"static_search"} and len(found) == 2
    assert Counter(r.source_name for r in errors) == {"static_reviews": len(UNITS), "static_maps": len(UNITS)}


def test_catalog_roles(spark):
    live = CAT.static_source("live", "maps", spark.createDataFrame([], "key string, pos int, url string, snippet string"))
    roles = CAT.build_catalog(spark, live={"live": live}, live_source="live")
    assert list(roles) == ["website", "search", "reviews", "maps"]
    assert roles["maps"].name == "live" and roles["search"].name == "static_search"
    assert CAT.build_catalog(spark, live={"live": live})["maps"].name == "static_maps"
    with pytest.raises(ValueError):
        CAT.build_catalog(spark, live={"live": live}, live_source="other")


DETAILS = {
    "googleMapsUri": "https://maps.test/1", "websiteUri": "https://site.test", "outdoorSeating": True,
    "reviewSummary": {"text": {"text": "People like the pier."}}, "editorialSummary": {"text": "A pier house."},
    "reviews": [{"text": {"text": "Wind and sun on the pier."}}, {"text": {"text": " "}},
                {"originalText": {"text": "Bra mat."}}, {"text": {"text": "Fourth"}}],
}


def place_rows(spark, details, search={"places": [{"id": "p1"}]}, **limits):
    searches = spark.createDataFrame([("The Quay, Oslo", json.dumps(search), None)],
                                     "match_key string, response string, call_error string")
    stored = spark.createDataFrame([("p1", json.dumps(details), None)],
                                   "place_id string, response string, call_error string")
    source = PL.places_source("places", searches, stored, **limits)
    rows = source.rows.orderBy("item_pos").collect()
    return rows, [r.error for r in source.errors.collect()]


def test_place_document(spark):
    rows, errors = place_rows(spark, DETAILS)
    assert [(r.source_type, r.reliability, r.url, r.snippet) for r in rows] == [
        ("maps", "high", "https://maps.test/1", "Google Places lists outdoor seating as available."),
        ("maps", "medium", "https://maps.test/1", "People like the pier."),
        ("maps", "medium", "https://site.test", "A pier house."),
        ("review", "low", "https://maps.test/1", "Wind and sun on the pier."),
        ("review", "low", "https://maps.test/1", "Bra mat."),
    ]
    assert errors == []


@pytest.mark.parametrize(("flag", "texts"), [
    (False, ["Google Places does not list outdoor seating as available."]), ("true", []), (None, []), (1, [])])
def test_only_booleans_speak_about_seating(spark, flag, texts):
    assert [r.snippet for r in place_rows(spark, {"outdoorSeating": flag})[0]] == texts


def test_review_limits(spark):
    rows, _ = place_rows(spark, DETAILS, max_reviews=2, max_chars=9)
    assert [r.snippet for r in rows if r.source_type == "review"] == ["Wind and"]


def test_editorial_text_and_empty_website(spark):
    rows, _ = place_rows(spark, {"googleMapsUri": "m", "websiteUri": "", "editorialSummary": " plain "})
    assert [(r.url, r.snippet) for r in rows] == [("m", "plain")]


@pytest.mark.parametrize("search", [{"places": []}, {}, {"places": [{"name": "x"}, {"id": "p1"}]}, {"places": [{"id": ""}]}])
def test_no_candidate_gives_no_evidence(spark, search):
    assert place_rows(spark, DETAILS, search) == ([], [])


def test_place_failures_are_reported(spark):
    searches = spark.createDataFrame(
        [("a", None, "boom"), ("b", "<html>", None), ("c", '{"places": [{"id": "none"}]}', None),
         ("d", '{"places": [{"id": "bad"}]}', None)], "match_key string, response string, call_error string")
    stored = spark.createDataFrame([("bad", None, "quota")], "place_id string, response string, call_error string")
    source = PL.places_source("places", searches, stored)
    assert source.rows.count() == 0
    assert {r.match_key: r.error for r in source.errors.collect()} == {
        "a": "boom", "b": "response is not valid JSON", "c": "no stored details for the place", "d": "quota"}


@pytest.mark.parametrize("search", [[{"id": "p1"}], "text", 5, {"places": [7]}, {"places": {"id": "p1"}}, {"places": "p1"}, {"places": [None]}, {"places": True}])
def test_misshapen_searches_fail(spark, search):
    assert place_rows(spark, DETAILS, search) == ([], ["response does not have the expected shape"])


@pytest.mark.parametrize("search", [{"places": 0}, {"places": {}}, {"places": ""}, {"places": None}, {"places": False}])
def test_searches_with_nothing_in_them_are_no_failure(spark, search):
    assert place_rows(spark, DETAILS, search) == ([], [])


@pytest.mark.parametrize("change", [
    {"reviews": {"text": "x"}}, {"reviews": ["plain"]}, {"reviews": [None]}, {"reviews": "plain"}, {"reviews": 3}, {"googleMapsUri": 5},
    {"googleMapsUri": 0}, {"websiteUri": 5}, {"googleMapsUri": [1], "outdoorSeating": None, "reviewSummary": None, "reviews": [{"text": "x"}]},
])
def test_misshapen_details_fail(spark, change):
    assert place_rows(spark, {**DETAILS, **change}) == ([], ["response does not have the expected shape"])


@pytest.mark.parametrize(("change", "n"), [
    ({"reviews": None}, 3), ({"reviews": {}}, 3), ({"reviews": 0}, 3), ({"websiteUri": 0}, 5), ({"websiteUri": 5, "editorialSummary": None}, 4),
    ({"reviews": [*DETAILS["reviews"][:3], "past the limit"]}, 5),
    ({"googleMapsUri": 5, "outdoorSeating": None, "reviewSummary": None, "reviews": []}, 1),
])
def test_odd_details_that_are_no_failure(spark, change, n):
    rows, errors = place_rows(spark, {**DETAILS, **change})
    assert (len(rows), errors) == (n, [])
