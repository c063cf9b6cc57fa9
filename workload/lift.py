"""Inputs of the operators, derived by Spark from the driver's tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload import sqltext as S
from workload import templates as TPL

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, good and bad, two for each id."""
    key = F.col("c_custkey")
    label = TPL.pick(["yes", "no", "unknown", None, "  ", "maybe", "yes"], key)
    text = F.concat(TPL.pick(TPL.SENTENCES, key), F.lit(" "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 29 != 3, F.concat(F.lit("c"), F.floor(key / 2).cast("string"))).alias("id"),
        F.when(key % 31 != 3, F.col("c_name")).alias("name"),
        F.when(key % 37 != 3, text).alias("evidence_text"),
        label.alias("expected_label"),
    )


_LABELS_SQL = S.pick(["yes", "no", "unknown", None, "  ", "maybe", "yes"], "c_custkey")
CUSTOMER_RECORDS_SQL = f"""
    raw_records AS (SELECT c_custkey AS seq,
        CASE WHEN c_custkey % 29 <> 3 THEN 'c' || CAST(c_custkey // 2 AS VARCHAR) END AS id,
        CASE WHEN c_custkey % 31 <> 3 THEN c_name END AS name,
        CASE WHEN c_custkey % 37 <> 3
             THEN {S.sentence('c_custkey')} || ' ' || c_mktsegment END AS evidence_text,
        {_LABELS_SQL} AS expected_label
        FROM customer),
    checked AS (SELECT * REPLACE (CASE WHEN trim(expected_label) <> '' THEN expected_label END
        AS expected_label),
        CASE WHEN id IS NULL THEN 'id is missing'
             WHEN name IS NULL THEN 'name is missing'
             WHEN evidence_text IS NULL THEN 'evidence_text is missing'
             WHEN trim(expected_label) <> '' AND expected_label NOT IN ('yes', 'no', 'unknown')
             THEN 'expected_label is not a known label' END AS reject_reason
        FROM raw_records),
    valid AS (SELECT * EXCLUDE (reject_reason) FROM checked WHERE reject_reason IS NULL)"""


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with whole documents as evidence and the quality flag as label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    key = F.col("doc_id")
    return docs.select(
        key.alias("seq"),
        F.concat(F.lit("d"), key.cast("string")).alias("id"),
        F.col("source").alias("name"),
        F.concat(TPL.pick(TPL.SENTENCES, key), F.lit("\n"), F.col("text")).alias("evidence_text"),
        F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("expected_label"),
    )


DOCUMENT_RECORDS_SQL = f"""
    valid AS (SELECT doc_id AS seq, 'd' || CAST(doc_id AS VARCHAR) AS id, source AS name,
        {S.sentence('doc_id')} || chr(10) || text AS evidence_text,
        CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS expected_label
        FROM documents LEFT JOIN labels USING (doc_id))"""


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short records; the rows of an order share an id."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("seq"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"),
        F.col("l_returnflag").alias("name"),
        F.concat(TPL.pick(TPL.SENTENCES, key), F.lit(" "), F.col("l_linestatus")).alias("evidence_text"),
        TPL.pick(["yes", "no", "unknown", None], key + F.col("l_orderkey")).alias("expected_label"),
    )


LINEITEM_RECORDS_SQL = f"""
    keyed AS (SELECT *, l_orderkey * 8 + l_linenumber AS key FROM lineitem),
    valid AS (SELECT key AS seq, 'o' || CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS name,
        {S.sentence('key')} || ' ' || l_linestatus AS evidence_text,
        {S.pick(['yes', 'no', 'unknown', None], 'key + l_orderkey')} AS expected_label
        FROM keyed)"""


def customer_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("c_name").alias("name"), F.col("n_name").alias("city"))


VENUES_SQL = """
    venue AS (SELECT c_custkey, c_name AS name, n_name AS city,
        lower(c_name || '|' || n_name) AS lookup_key
        FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each order: the venue is its customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(
        customer_venues(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("o_orderkey").alias("seq"), "name", "city",
        F.lit(None).cast("string").alias("website_url"),
    )


def _keyed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with the ``key`` of the venue of their ``c_custkey``.

    Each test table is one file with one row group, which one task would read and clean: the hint makes the join deal
    the rows out, once, and without sorting texts.
    """
    venues = customer_venues(spark, sf_dir).select("c_custkey", F.lower(F.concat_ws("|", "name", "city")).alias("key"))
    return rows.join(venues.hint("shuffle_hash"), "c_custkey")


def _keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are: the sources made from them share one shuffle."""
    return _keyed(spark, sf_dir, table(spark, sf_dir, "documents").select(
        _text_venue(spark, sf_dir, "doc_id").alias("c_custkey"), "doc_id", "text"
    ))


def _text_venue(spark: SparkSession, sf_dir: str, key: str) -> Column:
    """The customer a text belongs to; there are as many venues for texts as customers."""
    return F.col(key) % F.lit(_customers(spark, sf_dir))


@lru_cache(maxsize=16)
def _customers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


_N_VENUES = "(SELECT count(*) FROM customer)"


def search_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search snippets; a few entries have none."""
    key = F.col("doc_id")
    return _keyed_documents(spark, sf_dir).select(
        "key", key.alias("pos"),
        F.when(key % 3 != 0, F.concat(F.lit("https://s.test/"), key.cast("string"))).alias("url"),
        F.when(key % 97 != 5, F.col("text")).alias("snippet"),
    )


def review_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, and the documents again with other spacing."""
    turns = _keyed(spark, sf_dir, table(spark, sf_dir, "conversations").select(
        _text_venue(spark, sf_dir, "conv_id").alias("c_custkey"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.lit("").alias("url"), F.col("text").alias("snippet"),
    )).select("key", "pos", "url", "snippet")
    again = _keyed_documents(spark, sf_dir).select(
        "key", (F.col("doc_id") + 1_000_000_000_000).alias("pos"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))).alias("snippet"),
    )
    return turns.unionByName(again)


def maps_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template sentences for the venues whose key is also that of a supplier."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        key.alias("c_custkey"), F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit("https://m.test/"), key.cast("string")).alias("url"),
        TPL.pick(TPL.SENTENCES, key).alias("snippet"),
    )
    return _keyed(spark, sf_dir, rows).select("key", "pos", "url", "snippet")


_MAPS_SQL = f"""
        SELECT s_suppkey, 3, 'static_maps', 'maps', 0,
            'https://m.test/' || CAST(s_suppkey AS VARCHAR), {S.sentence('s_suppkey')}, 'medium'
            FROM supplier"""


def evidence_sql(maps: str = _MAPS_SQL, reported: str = "") -> str:
    """CTEs from ``venue`` to ``told``: ``maps`` gives the rows of the maps role, ``reported``
    more errors (name, city, source_ord, source_name, error)."""
    return f"""
    entry AS (
        SELECT doc_id % {_N_VENUES} AS c_custkey, 1 AS source_ord, 'static_search' AS source_name,
            'search' AS source_type, doc_id AS item_pos,
            CASE WHEN doc_id % 3 <> 0 THEN 'https://s.test/' || CAST(doc_id AS VARCHAR) END AS url,
            CASE WHEN doc_id % 97 <> 5 THEN text END AS snippet, 'medium' AS reliability
            FROM documents
        UNION ALL
        SELECT conv_id % {_N_VENUES}, 2, 'static_reviews', 'review', conv_id * 1000 + turn,
            '', text, 'low' FROM conversations
        UNION ALL
        SELECT doc_id % {_N_VENUES}, 2, 'static_reviews', 'review', doc_id + 1000000000000,
            NULL, ' ' || replace(text, ' ', '  '), 'low' FROM documents
        UNION ALL {maps}),
    all_rows AS (SELECT * FROM entry JOIN venue USING (c_custkey)),
    failed AS (SELECT DISTINCT name, city, lookup_key, source_ord, source_name FROM all_rows
        WHERE snippet IS NULL),
    gathered AS (SELECT a.* FROM all_rows a WHERE NOT EXISTS (SELECT 1 FROM failed f
        WHERE f.lookup_key = a.lookup_key AND f.source_ord = a.source_ord)),
    keyed AS (SELECT *, {S.snippet_key('snippet')} AS key FROM gathered),
    deduped AS (SELECT * FROM keyed QUALIFY row_number() OVER
        (PARTITION BY name, city, key ORDER BY source_ord, item_pos) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name, city ORDER BY
        CASE reliability WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
        CASE source_type WHEN 'website' THEN 0 WHEN 'maps' THEN 1 WHEN 'search' THEN 2 ELSE 3 END,
        source_name, key) AS rank FROM deduped),
    combined AS (SELECT name, city,
        string_agg('[' || source_type || ']' || CASE WHEN url <> '' THEN ' ' || url ELSE '' END
            || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS raw_text,
        list(snippet ORDER BY rank) AS snippets, list(url ORDER BY rank) AS urls,
        list(source_type ORDER BY rank) AS types
        FROM ranked GROUP BY name, city),
    told AS (SELECT name, city, list(source_name || ': ' || error ORDER BY source_ord) AS errors
        FROM (SELECT name, city, source_ord, source_name, '''snippet''' AS error FROM failed {reported})
        GROUP BY name, city)"""


EVIDENCE_SQL = f"{VENUES_SQL}, {evidence_sql()}"


def stored_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("name")
    response = TPL.fill(TPL.pick(TPL.SEARCHES, key), key, name)
    return customer_venues(spark, sf_dir).select(
        "c_custkey", F.concat_ws(", ", "name", "city").alias("match_key"),
        response.alias("response"),
        F.when(response.isNull(), F.lit(TPL.CALL_ERROR)).alias("call_error"),
    )


def stored_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), key.cast("string")).alias("place_id"),
        TPL.fill(TPL.pick(TPL.DETAILS, key), key, F.col("c_name")).alias("response"),
        F.lit(None).cast("string").alias("call_error"),
    )


DETAILS_SQL = f"""
    details AS (SELECT c_custkey, 'p' || CAST(c_custkey AS VARCHAR) AS place_id,
        {S.fill(S.pick(TPL.DETAILS, 'c_custkey'), 'c_custkey', 'c_name')} AS response,
        c_custkey % {len(TPL.DETAILS)} IN ({', '.join(map(str, TPL.MISSHAPEN_DETAILS))}) AS misshapen FROM customer)"""
SEARCHES_SQL = f"""
    {VENUES_SQL},
    searches AS (SELECT c_custkey, name || ', ' || city AS match_key,
        {S.fill(S.pick(TPL.SEARCHES, 'c_custkey'), 'c_custkey', 'name')} AS response,
        c_custkey % {len(TPL.SEARCHES)} IN ({', '.join(map(str, TPL.MISSHAPEN_SEARCHES))}) AS misshapen FROM venue)"""


def reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working rows for extraction; one in nineteen was never cleaned."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"), F.col("c_name").alias("restaurant_id"),
        F.when(key % 19 != 0, F.col("c_mktsegment")).alias("cleaned_text"),
        F.lit(None).cast("string").alias("error"),
    )


def stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")

    def attempt(number: int, texts: list[str | None], pick_by) -> DataFrame:
        reply = TPL.fill(TPL.pick(texts, pick_by), key, name)
        return customers.select(
            key.alias("seq"), F.lit(number).alias("attempt"), reply.alias("reply"),
            F.when(reply.isNull(), F.lit(TPL.CALL_ERROR)).alias("call_error"),
        )

    first = attempt(1, TPL.REPLIES_FIRST, key)
    return first.unionByName(attempt(2, TPL.REPLIES_SECOND, F.floor(key / 8)))


_FENCE = "(?is)```(?:json)?\\s*\\n?(.*?)\\n?```"


def _reply_sql(number: int, texts: list[str | None], pick_by: str) -> str:
    return (
        f"SELECT c_custkey AS seq, {number} AS attempt, "
        f"{S.fill(S.pick(texts, pick_by), 'c_custkey', 'c_name')} AS reply FROM customer"
    )


REPLIES_SQL = f"""
    reply_table AS ({_reply_sql(1, TPL.REPLIES_FIRST, 'c_custkey')}
        UNION ALL {_reply_sql(2, TPL.REPLIES_SECOND, 'c_custkey // 8')}),
    bare AS (SELECT *, CASE WHEN regexp_matches(reply, '{_FENCE}')
        THEN trim(regexp_extract(reply, '{_FENCE}', 1), ' ' || chr(10)) ELSE reply END AS body
        FROM reply_table),
    typed AS (SELECT *, coalesce(json_valid(body), false) AS is_json,
        CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS doc FROM bare),
    fields AS (SELECT *, json_extract_string(doc, '$.label') AS r_label,
        TRY_CAST(json_extract_string(doc, '$.confidence') AS DOUBLE) AS r_confidence,
        CASE WHEN json_type(doc, '$.evidence') = 'ARRAY'
             THEN json_extract_string(doc, '$.evidence[*]') END AS r_quotes,
        CASE WHEN json_type(doc, '$.evidence') = 'ARRAY'
             THEN list_transform(json_extract(doc, '$.evidence[*]'), lambda q: json_type(q)) END AS kinds,
        json_extract_string(doc, '$.reasoning') AS r_reason FROM typed),
    parsed AS (SELECT *, coalesce(r_label IN ('yes', 'no', 'unknown')
        AND r_confidence BETWEEN 0 AND 1 AND len(list_filter(kinds, lambda k: k <> 'VARCHAR')) = 0
        AND json_type(doc, '$.reasoning') = 'VARCHAR', false) AS ok FROM fields)"""
