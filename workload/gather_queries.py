"""Gather jobs: sources, merge, gate, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R
from venuesift.functions.jsontext import json_list
from venuesift.operators import merging as M
from venuesift.plans import gathering as G
from venuesift.session import configure, new_table_path
from venuesift.sources import catalog as CAT
from venuesift.sources import fetched as FET
from venuesift.sources import places as PL
from venuesift.sources import requests as REQ
from venuesift.sources import sinks
from workload import lift
from workload import sqltext as S
from workload.registry import query


def build_catalog(spark, sf_dir, **more):
    return CAT.build_catalog(
        spark,
        search=CAT.static_source("static_search", "search", lift.search_entries(spark, sf_dir)),
        reviews=CAT.static_source("static_reviews", "review", lift.review_entries(spark, sf_dir)),
        maps=CAT.static_source("static_maps", "maps", lift.maps_entries(spark, sf_dir)),
        **more,
    )


def places(spark, sf_dir):
    configure(spark)
    return PL.places_source(
        "stored_places", lift.stored_searches(spark, sf_dir), lift.stored_details(spark, sf_dir)
    )


def _matched(spark, sf_dir):
    """What all sources have for every customer venue, before the merge."""
    units = G.venues(lift.customer_venues(spark, sf_dir))
    return G.match(units, build_catalog(spark, sf_dir))


@query("static_evidence", f"""
    WITH {lift.VENUES_SQL}
    SELECT lookup_key AS match_key, 'static_maps' AS source_name, 'maps' AS source_type,
        CAST(pos AS BIGINT) AS item_pos, CASE WHEN pos = 0 THEN 'https://m.test/' || CAST(s_suppkey AS VARCHAR) END AS url,
        CASE WHEN pos = 0 THEN {S.sentence('s_suppkey')} ELSE s_name END AS snippet, 'medium' AS reliability
    FROM (SELECT *, unnest([0, 1]) AS pos FROM supplier) JOIN venue ON c_custkey = s_suppkey""")
def static_evidence(spark, sf_dir):
    """A keyed JSON catalog, one object on each line, written from the suppliers and read."""
    entries = lift.maps_entries(spark, sf_dir)
    names = lift.table(spark, sf_dir, "supplier").join(
        lift.customer_venues(spark, sf_dir), F.col("s_suppkey") == F.col("c_custkey")
    ).select(F.lower(F.concat_ws("|", "name", "city")).alias("key"), "s_name")
    listed = entries.join(names, "key").select(F.create_map("key", F.array(
        F.struct("url", "snippet"),
        F.struct(F.lit(None).cast("string").alias("url"), F.col("s_name").alias("snippet")),
    )).alias("entries"))
    path = new_table_path(spark, "catalog-json")
    listed.select(F.to_json("entries").alias("value")).write.text(path)
    read = CAT.read_entries(spark, path, one_object_per_line=True)
    return CAT.static_source("static_maps", "maps", read).rows.drop("key_kind")


@query("default_reliability", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT c_custkey, source_name, item_pos, CASE source_type WHEN 'review' THEN 'low' ELSE 'medium' END
        AS reliability FROM all_rows""")
def default_reliability(spark, sf_dir):
    venues = lift.customer_venues(spark, sf_dir).select(
        "c_custkey", F.lower(F.concat_ws("|", "name", "city")).alias("match_key")
    )
    rows = CAT.union_sources(build_catalog(spark, sf_dir)).join(venues, "match_key")
    return rows.select(
        "c_custkey", "source_name", "item_pos", R.default_reliability(F.col("source_type")).alias("reliability")
    )


@query("source_catalog", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT source_ord, source_name, source_type, lookup_key AS match_key, item_pos, url, snippet
    FROM all_rows""")
def source_catalog(spark, sf_dir):
    return CAT.union_sources(build_catalog(spark, sf_dir)).select(
        "source_ord", "source_name", "source_type", "match_key", "item_pos", "url", "snippet"
    )


@query("union_sources", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT source_ord, source_name, count(*) AS n, count(snippet) AS told,
        CAST(sum(length(snippet)) AS BIGINT) AS chars FROM all_rows GROUP BY source_ord, source_name""")
def union_sources(spark, sf_dir):
    return CAT.union_sources(build_catalog(spark, sf_dir)).groupBy("source_ord", "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("snippet").alias("told"),
        F.sum(F.length("snippet")).alias("chars"),
    )


_BAD_LINES = 7


@query("static_evidence_errors", f"""
    WITH {lift.VENUES_SQL}
    SELECT name, city, source_ord, source_name, 'catalog is not valid JSON' AS error FROM venue
    CROSS JOIN (VALUES (2, 'static_reviews'), (3, 'static_maps')) AS bad(source_ord, source_name)""")
def static_evidence_errors(spark, sf_dir):
    """Catalogs with a line that is no JSON, and with text behind an object, fail as a whole."""
    key = F.col("c_custkey")
    venues = lift.customer_venues(spark, sf_dir)
    entry = F.to_json(F.create_map(
        F.lower(F.concat_ws("|", "name", "city")), F.array(F.struct(F.lit("seats").alias("snippet")))
    ))
    path = new_table_path(spark, "broken-catalog")
    for file, line in {
        "search": entry,
        "reviews": F.when(key % _BAD_LINES == 0, "not an object").otherwise(entry),
        "maps": F.when(key % _BAD_LINES == 1, F.concat(entry, F.lit(" more"))).otherwise(entry),
    }.items():
        venues.select(line.alias("value")).write.text(f"{path}/{file}.json")
    return CAT.failed_sources(CAT.static_catalog(spark, path, one_object_per_line=True), G.venues(venues))


@query("place_candidate", f"""
    WITH {lift.SEARCHES_SQL}
    SELECT match_key, CASE WHEN json_valid(response)
        THEN json_extract_string(response, '$.places[0].id') END AS place_id FROM searches""")
def place_candidate(spark, sf_dir):
    configure(spark)
    return PL.place_candidate(lift.stored_searches(spark, sf_dir)).select("match_key", "place_id")


def _localized_sql(doc: str, path: str) -> str:
    cases = " ".join(
        f"WHEN json_type({doc}, '{path}{'.text' * n}') = 'VARCHAR' "
        f"THEN nullif(trim(json_extract_string({doc}, '{path}{'.text' * n}')), '')"
        for n in range(4)
    )
    return f"CASE {cases} END"


_DOCS_SQL = f"""
    {lift.DETAILS_SQL},
    docs AS (SELECT *, CAST(response AS JSON) AS doc, json_extract_string(CAST(response AS JSON),
        '$.googleMapsUri') AS maps_url FROM details WHERE json_valid(response) AND NOT misshapen),
    facts AS (
        SELECT c_custkey, place_id, 0 AS ord, 'maps' AS source_type, maps_url AS url,
            CASE json_extract_string(doc, '$.outdoorSeating') WHEN 'true'
                THEN 'Google Places lists outdoor seating as available.'
                ELSE 'Google Places does not list outdoor seating as available.' END AS snippet,
            'high' AS reliability FROM docs WHERE json_type(doc, '$.outdoorSeating') = 'BOOLEAN'
        UNION ALL
        SELECT c_custkey, place_id, 1, 'maps', maps_url, {_localized_sql('doc', '$.reviewSummary')}, 'medium' FROM docs
        UNION ALL
        SELECT c_custkey, place_id, 2, 'maps',
            coalesce(nullif(json_extract_string(doc, '$.websiteUri'), ''), maps_url),
            {_localized_sql('doc', '$.editorialSummary')}, 'medium' FROM docs),
    review AS (SELECT c_custkey, place_id, 2 + n AS ord, 'review' AS source_type, maps_url AS url,
            trim(substr(coalesce({_localized_sql('r', '$.text')}, {_localized_sql('r', '$.originalText')}), 1, 300))
                AS snippet, 'low' AS reliability
        FROM (SELECT *, unnest(json_extract(doc, '$.reviews[*]')) AS r,
                generate_subscripts(json_extract(doc, '$.reviews[*]'), 1) AS n FROM docs)
        WHERE n <= 3)"""


def _details_items(spark, sf_dir):
    configure(spark)
    doc = F.try_parse_json("response")
    return lift.stored_details(spark, sf_dir).filter(~PL.details_misshapen(doc)).withColumn("doc", doc)


@query("place_facts_evidence", f"""
    WITH {_DOCS_SQL}
    SELECT place_id, CAST(row_number() OVER (PARTITION BY place_id ORDER BY ord) - 1 AS INTEGER) AS pos,
        source_type, url, snippet, reliability FROM facts WHERE snippet IS NOT NULL""")
def place_facts_evidence(spark, sf_dir):
    items = PL.place_facts(F.col("doc"))
    return _details_items(spark, sf_dir).select(
        "place_id", F.posexplode(items).alias("pos", "item")
    ).select("place_id", "pos", "item.*")


@query("place_reviews_evidence", f"""
    WITH {_DOCS_SQL}
    SELECT place_id, CAST(row_number() OVER (PARTITION BY place_id ORDER BY ord) - 1 AS INTEGER) AS pos,
        source_type, url, snippet, reliability FROM review WHERE snippet IS NOT NULL""")
def place_reviews_evidence(spark, sf_dir):
    items = PL.place_reviews(F.col("doc"), C.DEFAULT_MAX_REVIEWS, C.DEFAULT_REVIEW_CHARS)
    return _details_items(spark, sf_dir).select(
        "place_id", F.posexplode(items).alias("pos", "item")
    ).select("place_id", "pos", "item.*")


_PLACES_ROWS_SQL = f"""
    {_DOCS_SQL}, {lift.SEARCHES_SQL},
    items AS (SELECT * FROM facts WHERE snippet IS NOT NULL UNION ALL BY NAME
        SELECT * FROM review WHERE snippet IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY ord) - 1 AS item_pos FROM items),
    asked AS (SELECT *, CASE WHEN json_valid(response) AND NOT misshapen
        THEN json_extract_string(response, '$.places[0].id') END AS pid FROM searches),
    place_errors AS (SELECT a.c_custkey, match_key, CASE WHEN a.response IS NULL THEN 'service unavailable'
        WHEN a.misshapen OR (json_valid(a.response) AND d.misshapen)
            THEN 'response does not have the expected shape'
        ELSE 'response is not valid JSON' END AS error
        FROM asked a LEFT JOIN details d ON pid = place_id
        WHERE a.response IS NULL OR NOT json_valid(a.response) OR NOT json_valid(d.response)
            OR a.misshapen OR d.misshapen)"""


@query("places_source", f"""
    WITH {_PLACES_ROWS_SQL}
    SELECT match_key, 'stored_places' AS source_name, n.source_type, CAST(item_pos AS BIGINT) AS item_pos, n.url,
        n.snippet, n.reliability FROM asked JOIN numbered n ON pid = place_id""")
def places_source(spark, sf_dir):
    return places(spark, sf_dir).rows.drop("key_kind")


@query("places_source_errors", f"""
    WITH {_PLACES_ROWS_SQL}
    SELECT match_key, error FROM place_errors""")
def places_source_errors(spark, sf_dir):
    return places(spark, sf_dir).errors.select("match_key", "error")


@query("gather_sources", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, source_ord, source_name, source_type, item_pos, url, snippet, reliability FROM gathered""")
def gather_sources(spark, sf_dir):
    return _matched(spark, sf_dir).evidence()


@query("source_errors", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, source_ord, source_name, '''snippet''' AS error FROM failed""")
def source_errors(spark, sf_dir):
    return _matched(spark, sf_dir).errors


@query("collect_errors", f"""
    WITH {lift.EVIDENCE_SQL} SELECT name, city, {S.json_list('errors')} AS gather_errors FROM told""")
def collect_errors(spark, sf_dir):
    return M.collect_errors(_matched(spark, sf_dir).errors, G.VENUE).withColumn(
        "gather_errors", json_list(F.col("gather_errors"))
    )


@query("dedup_evidence", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, source_ord, source_name, source_type, item_pos, url, snippet, reliability FROM deduped""")
def dedup_evidence(spark, sf_dir):
    return _matched(spark, sf_dir).deduped()


@query("rank_evidence", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, rank, source_name, source_type, url, snippet, reliability FROM ranked""")
def rank_evidence(spark, sf_dir):
    return _matched(spark, sf_dir).ranked().select(
        "name", "city", "rank", "source_name", "source_type", "url", "snippet", "reliability"
    )


def _assembled(spark, sf_dir):
    return M.assemble_evidence(_matched(spark, sf_dir).ranked(), G.VENUE)


@query("combine_evidence", f"WITH {lift.EVIDENCE_SQL} SELECT name, city, raw_text FROM combined")
def combine_evidence(spark, sf_dir):
    return _assembled(spark, sf_dir).select(
        "name", "city", M.combine_evidence(F.col("items")).alias("raw_text")
    )


@query("provenance_lists", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, {S.json_list('snippets')} AS source_evidence_snippets,
        {S.json_list('urls')} AS source_urls, {S.json_list('types')} AS source_types FROM combined""")
def provenance_lists(spark, sf_dir):
    lists = {k: json_list(c) for k, c in M.provenance(F.col("items")).items()}
    return _assembled(spark, sf_dir).withColumns(lists).drop("items")


@query("no_evidence_gate", f"""
    WITH {lift.EVIDENCE_SQL}
    SELECT name, city, CASE WHEN raw_text IS NULL THEN 'No evidence gathered from any source' END AS error,
        CASE WHEN raw_text IS NULL THEN 'failed' END AS validation_status, raw_text IS NULL AS needs_review
    FROM venue LEFT JOIN combined USING (name, city)""")
def no_evidence_gate(spark, sf_dir):
    units = G.venues(lift.customer_venues(spark, sf_dir))
    counted = _matched(spark, sf_dir).links.groupBy(*G.VENUE).agg(F.count(F.lit(1)).alias("found"))
    rows = units.join(counted, G.VENUE, "left")
    return M.no_evidence_gate(rows, F.col("found") > 0).drop("found")


def gather_sql(requests: str, where: str = "", evidence: str = lift.EVIDENCE_SQL) -> str:
    slug = "trim(regexp_replace(lower(name || '-' || city), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"""
    WITH {evidence},
    cleaned AS (SELECT *, {S.clean('raw_text')} AS cleaned_text FROM combined),
    {S.classify_ctes('cleaned', 'cleaned_text')},
    answer AS (SELECT v.name, v.city, label, confidence, quotes, snippets, urls, types, reasoning,
        errors, label IS NOT NULL AS live,
        label IS NULL OR confidence < 0.6 OR (label <> 'unknown' AND len(quotes) = 0) AS review
        FROM venue v LEFT JOIN cls USING (name, city) LEFT JOIN told t
        ON t.name = v.name AND t.city = v.city)
    SELECT {slug} AS restaurant_id, name, city, label AS prediction, confidence,
        {S.json_list('coalesce(quotes, [])')} AS evidence,
        {S.json_list('coalesce(snippets, [])')} AS source_evidence_snippets,
        {S.json_list('coalesce(urls, [])')} AS source_urls,
        {S.json_list('coalesce(types, [])')} AS source_types, reasoning,
        CASE WHEN NOT live THEN 'failed' WHEN review THEN 'flagged' ELSE 'ok' END AS validation_status,
        review AS needs_review, {S.json_list('coalesce(errors, [])')} AS gather_errors,
        CASE WHEN NOT live THEN 'No evidence gathered from any source' END AS error
    FROM {requests} {where}"""


_ORDERS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN answer ON name = c_name AND city = n_name"""
_ONE_EACH = "answer"


def _customer_requests(spark, sf_dir):
    return lift.customer_venues(spark, sf_dir).withColumnRenamed("c_custkey", "seq")


@query("gather_results_rows", gather_sql(_ONE_EACH))
def gather_results_rows(spark, sf_dir):
    return sinks.gather_results_rows(
        G.process_requests(_customer_requests(spark, sf_dir), build_catalog(spark, sf_dir))
    )


@query("gather_review_queue", gather_sql(_ONE_EACH, "WHERE review"))
def gather_review_queue(spark, sf_dir):
    out = new_table_path(spark, "gather-queue")
    G.run_gather_job(_customer_requests(spark, sf_dir), build_catalog(spark, sf_dir), out)
    return G.job_review_queue(spark, out, in_order=False)


@query("gather_job", gather_sql(_ORDERS))
def gather_job(spark, sf_dir):
    """The whole job with its written tables, one request for each order."""
    return G.run_gather_job(
        lift.order_requests(spark, sf_dir), build_catalog(spark, sf_dir), new_table_path(spark, "gather-job")
    )


_PLACES_EVIDENCE_SQL = f"""{_PLACES_ROWS_SQL}, {lift.evidence_sql(
    maps='''SELECT asked.c_custkey, 3, 'stored_places', n.source_type, item_pos, n.url, n.snippet, n.reliability
            FROM asked JOIN numbered n ON pid = place_id''',
    reported='''UNION ALL SELECT name, city, 3, 'stored_places', error FROM place_errors JOIN venue USING (c_custkey)''',
)}"""


@query("gather_job_places", gather_sql(_ORDERS, evidence=_PLACES_EVIDENCE_SQL))
def gather_job_places(spark, sf_dir):
    """The whole job with stored place answers in the maps role."""
    live = {"places": places(spark, sf_dir)}
    catalog = build_catalog(spark, sf_dir, live=live, live_source="places")
    return G.run_gather_job(lift.order_requests(spark, sf_dir), catalog, new_table_path(spark, "gather-places"))


_REQUESTS_SQL = f"""
    WITH {lift.VENUES_SQL}, asked AS (SELECT o_orderkey AS seq,
        CASE WHEN o_orderkey % 11 <> 3 THEN name END AS name,
        CASE WHEN o_orderkey % 13 <> 3 THEN city END AS city
        FROM orders JOIN venue ON o_custkey = c_custkey)"""


def _odd_requests(spark, sf_dir):
    key = F.col("seq")
    return lift.order_requests(spark, sf_dir).select(
        "seq", F.when(key % 11 != 3, F.col("name")).alias("name"), F.when(key % 13 != 3, F.col("city")).alias("city")
    )


@query("validate_requests", f"{_REQUESTS_SQL} SELECT * FROM asked WHERE name IS NOT NULL AND city IS NOT NULL")
def validate_requests(spark, sf_dir):
    return REQ.validate_requests(_odd_requests(spark, sf_dir))


@query("rejected_requests", f"""{_REQUESTS_SQL}
    SELECT *, CASE WHEN name IS NULL THEN 'name is missing' ELSE 'city is missing' END AS reject_reason
    FROM asked WHERE name IS NULL OR city IS NULL""")
def rejected_requests(spark, sf_dir):
    """As the job writes them."""
    out = new_table_path(spark, "gather-rejected")
    G.run_gather_job(_odd_requests(spark, sf_dir), build_catalog(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/rejected")


@query("fetched_source", f"""
    WITH {lift.VENUES_SQL}
    SELECT DISTINCT lookup_key AS match_key, CASE WHEN right(name, 1) <> '7' THEN CAST(0 AS BIGINT) END AS item_pos,
        CASE WHEN right(name, 1) <> '7' THEN 'Tables outside ' || name END AS snippet,
        CASE WHEN right(name, 1) <> '7' THEN 'low' END AS reliability,
        CASE WHEN right(name, 1) = '7' THEN name || ' timed out' END AS error
    FROM venue WHERE right(name, 1) <> '3'""")
def fetched_source(spark, sf_dir):
    """A source asked venue by venue, which fails for some of them and has nothing for others."""
    def make_fetch():
        def fetch(name, city):
            if name.endswith("7"):
                raise TimeoutError(f"{name} timed out")
            return [] if name.endswith("3") else [{"snippet": f"Tables outside {name}"}]

        return fetch

    source = FET.fetched_source(lift.customer_venues(spark, sf_dir), "live", "review", make_fetch)
    rows = source.rows.select("match_key", "item_pos", "snippet", "reliability", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(source.errors.select("match_key", "error"), allowMissingColumns=True)
