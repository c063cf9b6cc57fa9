"""The queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesift.llm import alignment, chat, exact, extraction, mixing, packing, phrases, quality, repeats, secrets, simhash, topk, warc
from venuesift.llm.registry import query, table

_TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op1_topk_search", _TOPK_SQL)
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.filter(F.col("id") % 50 == 0)
    return topk.search(queries, vectors, k=5, scale=256).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )


_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), kept AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS text_chars,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) AS role_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + role_chars + 1 + text_chars + 8)::BIGINT AS formatted_chars
FROM kept GROUP BY conv_id
"""


@query("op2_chat_format", _CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chats(chats)).drop("rewritten_at")


@query("op3_pack_documents")
def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), packing.tokenizers_encoder))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS top,
    row_number() OVER (PARTITION BY payload, page_id) AS nth
  FROM payloads
), digests AS (
  SELECT *, sha1(payload) AS hex FROM placed
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('{_BASE32}', (((('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT) >> s) & 31)::BIGINT + 1, 1)
  ), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top AND nth = 1 THEN NULL ELSE top END AS refers_to
FROM digests
"""


@query("op4_warc", _WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives, payloads=False).drop("url", "payload")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    good = F.col("score") >= quality.THRESHOLD
    return quality.scores(docs, model).select(
        F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score",
        good.cast("int").alias("predicted"),
    )


_EXTRACT_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), plain AS (
  SELECT page_id, url, replace(replace(replace(replace(
    regexp_replace(body, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text
  FROM inner_html
), folded AS (
  SELECT page_id, url, trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM folded
"""


@query("op6_extract_html", _EXTRACT_SQL)
def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


_EXACT_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
    AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
  sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""


@query("op8_exact_dedup", _EXACT_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.col("digest").alias("text_sha256"),
    )


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, 2 * words AS most, row_number() OVER (ORDER BY 2 * words / weight, source) AS nth FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(words) OVER ())::DOUBLE - coalesce(sum(most) OVER before, 0)::DOUBLE)
    / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT)::DOUBLE AS level
  FROM ordered WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, nth) AS level FROM levels WHERE most::DOUBLE > level * weight
), targets AS (
  SELECT source, words, least(most::DOUBLE, coalesce(level.level, most::DOUBLE / weight) * weight) AS target,
    (('0x' || substr(md5('mix-1:' || coalesce('=' || source, 'none')), 1, 8))::BIGINT) & 1073741823 AS shift
  FROM ordered CROSS JOIN level
), placed AS (
  SELECT d.*, t.words, t.target, t.shift,
    CASE WHEN t.words > 0 THEN floor(t.target / t.words * 1073741824)::BIGINT ELSE 0 END AS step,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS i
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
  (((i + 1)::HUGEINT * step + shift) // 1073741824 - (i::HUGEINT * step + shift) // 1073741824)::BIGINT * size AS taken
FROM placed
"""


@query("op10_mix_sources", _MIX_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


_REPEATS_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS bytes,
    octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), windows AS (
  SELECT rid, i, md5(substr(bytes, 2 * i + 1, 400)) AS digest FROM (SELECT rid, bytes, unnest(range(n - 199)) AS i FROM texts)
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY digest) > 1
), runs AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM repeated)
), spans AS (
  SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY rid, run
), gaps AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS gap_start FROM spans
), cut AS (
  SELECT texts.rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
    string_agg(substr(bytes, 2 * gap_start + 1, 2 * (a - gap_start)), '' ORDER BY a) || substr(any_value(bytes), 2 * max(b) + 1) AS kept
  FROM gaps JOIN texts USING (rid) GROUP BY texts.rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, bytes))) AS kept_sha256
FROM texts LEFT JOIN cut USING (rid)
"""


@query("op11_suffix_dedup", _REPEATS_SQL)
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
  )), '[^\x20\x09]+') AS words
  FROM documents
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: words[i:i + size - 1])) AS gram
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size)
), counts AS (
  SELECT lang, size, gram, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30 OR size = 1
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), phrases AS (
  SELECT lang, size, gram, f AS a FROM counts WHERE size > 1
), cuts AS (
  SELECT p.*, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM phrases) p
  JOIN counts x ON x.lang = p.lang AND x.gram = p.gram[1:k] JOIN counts y ON y.lang = p.lang AND y.gram = p.gram[k + 1:p.size]
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), inside AS (
  SELECT lang, gram[i:i + m - 1] AS gram, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM phrases))
  GROUP BY ALL
), ranked AS (
  SELECT w.*, array_to_string(gram, ' ') AS phrase FROM weakest w LEFT JOIN inside USING (lang, gram)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_phrase_mining", _PHRASES_SQL)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
