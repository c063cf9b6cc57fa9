"""Model replies: parsing, schema check, repair, and the hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuesift.functions import prompts as P
from venuesift.functions.jsontext import json_list
from venuesift.operators.replies import collect_replies, extract_with_repair, parse_response
from venuesift.session import configure
from workload import lift
from workload import sqltext as S
from workload.registry import query


def _parsed(spark, sf_dir):
    configure(spark)
    return parse_response(lift.stored_replies(spark, sf_dir), "reply")


@query("parse_response", f"""
    WITH {lift.REPLIES_SQL}
    SELECT seq, attempt, is_json, CASE WHEN ok THEN r_label END AS label,
        CASE WHEN ok THEN r_confidence END AS confidence,
        {S.json_list('CASE WHEN ok THEN r_quotes ELSE [] END')} AS quotes,
        CASE WHEN ok THEN r_reason END AS reasoning FROM parsed""")
def parse_response_(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "seq", "attempt", "parsed.is_json", "parsed.extraction.label", "parsed.extraction.confidence",
        json_list(F.col("parsed.extraction.evidence")).alias("quotes"), "parsed.extraction.reasoning",
    )


@query("response_schema_ok", f"WITH {lift.REPLIES_SQL} SELECT seq, attempt, ok AS schema_ok FROM parsed")
def response_schema_ok(spark, sf_dir):
    return _parsed(spark, sf_dir).select("seq", "attempt", "parsed.schema_ok")


_PREDICTION = ["seq", "restaurant_id", "prediction", "confidence", "evidence", "reasoning", "error"]


@query("extract_with_repair", f"""
    WITH {lift.REPLIES_SQL},
    tries AS (SELECT c.c_custkey AS seq, c_name AS restaurant_id, c.c_custkey % 19 <> 0 AS ready,
        a.reply IS NULL AS failed1, a.ok AS ok1, b.reply IS NULL AS failed2, b.ok AS ok2,
        b.is_json AS json2, CASE WHEN a.ok THEN a ELSE b END AS hit
        FROM customer c JOIN parsed a ON a.seq = c.c_custkey AND a.attempt = 1
        JOIN parsed b ON b.seq = c.c_custkey AND b.attempt = 2),
    judged AS (SELECT *, ready AND NOT failed1 AND (ok1 OR ok2) AS found FROM tries)
    SELECT seq, restaurant_id, CASE WHEN found THEN hit.r_label END AS prediction,
        CASE WHEN found THEN hit.r_confidence END AS confidence,
        {S.json_list('CASE WHEN found THEN hit.r_quotes ELSE [] END')} AS evidence,
        CASE WHEN found THEN hit.r_reason END AS reasoning,
        CASE WHEN NOT ready THEN 'Missing cleaned_text: run preprocessing first.'
             WHEN failed1 THEN 'service unavailable'
             WHEN ok1 THEN NULL WHEN failed2 THEN 'service unavailable'
             WHEN NOT ok2 THEN 'Failed to parse extraction JSON after repair retry: '
                || CASE WHEN json2 THEN 'reply does not match the schema'
                        ELSE 'reply is not valid JSON' END END AS error
    FROM judged""")
def extract_with_repair_(spark, sf_dir):
    configure(spark)
    done = extract_with_repair(lift.reply_records(spark, sf_dir), lift.stored_replies(spark, sf_dir))
    return done.withColumn("evidence", json_list(F.col("evidence"))).select(*_PREDICTION)


def _stub_factory():
    """A model stand-in: quotes length and digest of the evidence it was sent, stumbles once on
    French, always on Spanish.

    The functions are nested so that they ship to executors by value.
    """
    marks = (P._USER_HEAD, P._USER_TAIL, P._REPAIR_MIDDLE, P._REPAIR_TAIL)

    def make():
        import hashlib
        import json

        head, tail, middle, end = marks

        def complete(system: str, user: str) -> str:
            repair = not user.startswith(head)
            evidence = user.split(middle, 1)[1].removesuffix(end) if repair else user[len(head):].removesuffix(tail)
            if evidence.startswith("es ") or (evidence.startswith("fr ") and not repair):
                return "sorry"
            if evidence.startswith("de "):
                raise RuntimeError("quota used up")
            return json.dumps({
                "label": "unknown" if repair else "yes", "confidence": 0.7, "reasoning": "stub",
                "evidence": [str(len(evidence)), hashlib.sha256(evidence.encode()).hexdigest()],
            })

        return complete

    return make


@query("completion_hook", """
    SELECT doc_id AS seq, 'd' || CAST(doc_id AS VARCHAR) AS restaurant_id,
        CASE lang WHEN 'fr' THEN 'unknown' WHEN 'es' THEN NULL WHEN 'de' THEN NULL ELSE 'yes' END
            AS prediction,
        CASE WHEN lang IN ('es', 'de') THEN NULL ELSE CAST(0.7 AS DOUBLE) END AS confidence,
        CASE WHEN lang IN ('es', 'de') THEN '[]' ELSE '["' || length(lang || ' ' || text) || '", "'
            || sha256(lang || ' ' || text) || '"]' END AS evidence,
        CASE WHEN lang IN ('es', 'de') THEN NULL ELSE 'stub' END AS reasoning,
        CASE lang WHEN 'de' THEN 'quota used up'
            WHEN 'es' THEN 'Failed to parse extraction JSON after repair retry: reply is not valid JSON'
            END AS error
    FROM documents""")
def completion_hook(spark, sf_dir):
    configure(spark)
    docs = lift.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("restaurant_id"),
        F.concat_ws(" ", "lang", "text").alias("cleaned_text"),
        F.lit(None).cast("string").alias("error"),
    )
    done = extract_with_repair(docs, collect_replies(docs, _stub_factory(), waves=2))
    return done.withColumn("evidence", json_list(F.col("evidence"))).select(*_PREDICTION)
