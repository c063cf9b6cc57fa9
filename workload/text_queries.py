"""Text expressions over whole pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuesift.functions import prompts as P
from venuesift.functions import text as X
from venuesift.functions.jsontext import json_list, localized_text, variant_at
from venuesift.operators.classify import keyword_classify
from venuesift.operators.cleaning import clean_evidence, strip_boilerplate
from workload import lift
from workload import sqltext as S
from workload import templates as TPL
from workload.registry import query

# Documents and pages, each with a template line in front.
_TEXTS_SQL = f"""
    texts AS (
        SELECT 'd' AS kind, doc_id AS id, {S.sentence('doc_id')} || chr(10) || text AS body FROM documents
        UNION ALL
        SELECT 'p', page_id, {S.sentence('page_id')} || chr(10) || html FROM pages)"""


def _texts(spark, sf_dir):
    def part(table, kind, key, text):
        body = F.concat(TPL.pick(TPL.SENTENCES, F.col(key)), F.lit("\n"), F.col(text))
        return lift.table(spark, sf_dir, table).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), body.alias("body")
        )

    texts = part("documents", "d", "doc_id", "text").unionByName(part("pages", "p", "page_id", "html"))
    # Each test table is one file with one row group, which one task would clean.
    return texts.repartition(spark.sparkContext.defaultParallelism, "kind", "id")


@query("normalise_whitespace", f"WITH {_TEXTS_SQL} SELECT kind, id, {S.normalise('body')} AS out FROM texts")
def normalise_whitespace(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", X.normalise_whitespace(F.col("body")).alias("out"))


@query("strip_boilerplate", f"WITH {_TEXTS_SQL} SELECT kind, id, {S.strip_boilerplate('body')} AS out FROM texts")
def strip_boilerplate_(spark, sf_dir):
    return strip_boilerplate(_texts(spark, sf_dir), "body", "out").select("kind", "id", "out")


@query("clean_evidence", f"WITH {_TEXTS_SQL} SELECT kind, id, {S.clean('body')} AS out FROM texts")
def clean_evidence_(spark, sf_dir):
    return clean_evidence(_texts(spark, sf_dir), "body", "out").select("kind", "id", "out")


@query("snippet_key", f"WITH {_TEXTS_SQL} SELECT kind, id, {S.snippet_key('body')} AS out FROM texts")
def snippet_key(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", X.snippet_key(F.col("body")).alias("out"))


@query("lookup_key", f"WITH {lift.VENUES_SQL} SELECT c_custkey, lookup_key FROM venue")
def lookup_key(spark, sf_dir):
    return lift.customer_venues(spark, sf_dir).select(
        "c_custkey", X.lookup_key(F.col("name"), F.col("city")).alias("lookup_key")
    )


@query("place_query_text", f"WITH {lift.VENUES_SQL} SELECT c_custkey, name || ', ' || city AS text FROM venue")
def place_query_text(spark, sf_dir):
    return lift.customer_venues(spark, sf_dir).select(
        "c_custkey", X.place_query_text(F.col("name"), F.col("city")).alias("text")
    )


_SLUG_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("entity_slug", f"""
    SELECT doc_id, coalesce(nullif({_SLUG_SQL.format("text || '-' || source")}, ''),
        'unknown-restaurant') AS slug FROM documents""")
def entity_slug(spark, sf_dir):
    return lift.table(spark, sf_dir, "documents").select(
        "doc_id", X.entity_slug(F.col("text"), F.col("source")).alias("slug")
    )


@query("strip_fences", f"""
    WITH {lift.REPLIES_SQL}, turns AS (SELECT conv_id, turn, CASE turn % 3
        WHEN 0 THEN text WHEN 1 THEN 'Here: ```json' || chr(10) || text || chr(10) || '``` done'
        ELSE '```' || text || '``` and ```more```' END AS body FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(body, '{lift._FENCE}')
        THEN {S.strip(f"regexp_extract(body, '{lift._FENCE}', 1)")} ELSE {S.strip('body')} END AS out
    FROM turns""")
def strip_fences(spark, sf_dir):
    text = F.col("text")
    body = (
        F.when(F.col("turn") % 3 == 0, text)
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: ```json\n"), text, F.lit("\n``` done")))
        .otherwise(F.concat(F.lit("```"), text, F.lit("``` and ```more```")))
    )
    return lift.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.strip_fences(body).alias("out")
    )


@query("build_prompt", f"""
    SELECT doc_id, {S.quote(P.SYSTEM_PROMPT)} AS system_prompt,
        {S.quote(P._USER_HEAD)} || text || {S.quote(P._USER_TAIL)} AS user_prompt FROM documents""")
def build_prompt(spark, sf_dir):
    return lift.table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(P.SYSTEM_PROMPT).alias("system_prompt"),
        P.user_prompt(F.col("text")).alias("user_prompt"),
    )


@query("repair_prompt", f"""
    WITH {lift.REPLIES_SQL}
    SELECT seq, attempt, {S.quote(P._REPAIR_HEAD)} || reply || {S.quote(P._REPAIR_MIDDLE)}
        || c_mktsegment || {S.quote(P._REPAIR_TAIL)} AS prompt
    FROM reply_table JOIN customer ON seq = c_custkey WHERE reply IS NOT NULL""")
def repair_prompt(spark, sf_dir):
    customers = lift.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), "c_mktsegment"
    )
    replies = lift.stored_replies(spark, sf_dir).filter(F.col("reply").isNotNull())
    return replies.join(customers, "seq").select(
        "seq", "attempt", P.repair_prompt(F.col("reply"), F.col("c_mktsegment")).alias("prompt")
    )


@query("first_sentence", f"WITH {_TEXTS_SQL} SELECT kind, id, {S.first_sentence('body')} AS out FROM texts")
def first_sentence(spark, sf_dir):
    return _texts(spark, sf_dir).select("kind", "id", X.first_sentence(F.col("body")).alias("out"))


_PROMPT_SQL = f"{S.quote(P._USER_HEAD)} || body || {S.quote(P._USER_TAIL)}"


@query("prompt_evidence", f"""
    WITH {_TEXTS_SQL}, prompts AS (SELECT kind, id,
        CASE WHEN id % 2 = 0 THEN {_PROMPT_SQL} ELSE body END AS prompt FROM texts),
    found AS (SELECT *, position('Evidence:' || chr(10) IN prompt) AS start_ FROM prompts)
    SELECT kind, id, CASE WHEN start_ > 0 THEN {S.cut('substr(prompt, start_ + 10)')}
        ELSE {S.strip('prompt')} END AS out FROM found""")
def prompt_evidence(spark, sf_dir):
    body = F.col("body")
    prompt = F.when(F.col("id") % 2 == 0, P.user_prompt(body)).otherwise(body)
    return _texts(spark, sf_dir).select("kind", "id", X.prompt_evidence(prompt).alias("out"))


_DEEP = 10
_LOCALIZED = ['"{n}"', '{"text": " {n} "}', '{"text": {"text": "{n}", "x": 1}}', "5", "null",
              '{"text": {"text": {"text": "{n}"}}}', '"  "', '{"other": "{n}"}', "[1]",
              '{"text":' * _DEEP + '"{n}"' + "}" * _DEEP, '{"text": ' * 6 + "[5]" + "}" * 6]
_LEVELS_SQL = " ".join(
    f"WHEN json_type(doc, '${'.text' * n}') = 'VARCHAR' THEN json_extract_string(doc, '${'.text' * n}')"
    for n in range(_DEEP + 1)
)


@query("localized_text", f"""
    WITH docs AS (SELECT c_custkey,
        CAST({S.fill(S.pick(_LOCALIZED, 'c_custkey'), 'c_custkey', 'c_name')} AS JSON) AS doc FROM customer)
    SELECT c_custkey, nullif(trim(CASE {_LEVELS_SQL} END), '') AS out FROM docs""")
def localized_text_(spark, sf_dir):
    key = F.col("c_custkey")
    doc = F.try_parse_json(TPL.fill(TPL.pick(_LOCALIZED, key), key, F.col("c_name")))
    return lift.table(spark, sf_dir, "customer").select(
        "c_custkey", doc.alias("doc")
    ).select("c_custkey", localized_text(variant_at(F.col("doc"), "$")).alias("out"))


@query("json_list", f"""
    WITH lists AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[])
        WHEN 1 THEN [text, NULL, 'a"b\\c' || chr(9)] ELSE [source, text] END AS items FROM documents)
    SELECT doc_id, {S.json_list('items')} AS out FROM lists""")
def json_list_(spark, sf_dir):
    items = (
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 4 == 1, F.array("text", F.lit(None), F.lit('a"b\\c\t')))
        .otherwise(F.array("source", "text"))
    )
    return lift.table(spark, sf_dir, "documents").select("doc_id", json_list(items).alias("out"))


@query("keyword_classify", f"""
    WITH {_TEXTS_SQL}, cleaned AS (SELECT kind, id, {S.clean('body')} AS cleaned_text FROM texts),
    {S.classify_ctes('cleaned', 'cleaned_text')}
    SELECT kind, id, label, confidence, {S.json_list('quotes')} AS quotes, reasoning FROM cls""")
def keyword_classify_(spark, sf_dir):
    cleaned = clean_evidence(_texts(spark, sf_dir), "body")
    prompts = cleaned.withColumn("prompt", P.user_prompt(F.col("cleaned_text")))
    return keyword_classify(prompts, "prompt", is_prompt=True).select(
        "kind", "id", "extraction.label", "extraction.confidence",
        json_list(F.col("extraction.evidence")).alias("quotes"), "extraction.reasoning",
    )
