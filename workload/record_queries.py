"""Record jobs: reading, checking, validation rules, metrics, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuesift import contracts as C
from venuesift.functions import rules as R
from venuesift.operators.metrics import evaluate, join_expected
from venuesift.operators.ordering import limit_records
from venuesift.operators.validation import route_records, validate_predictions
from venuesift.plans.batch import run_job
from venuesift.session import new_table_path
from venuesift.sources import records as REC
from venuesift.sources import sinks
from workload import lift
from workload import sqltext as S
from workload import templates as TPL
from workload.registry import query


def _csv_rows(spark, sf_dir):
    """Customer records with cells that are hard to write: padding, quotes, line breaks, tokens."""
    key = F.col("seq")
    raw = lift.customer_records(spark, sf_dir)
    return raw.select(
        "seq", F.when(key % 5 == 0, "NA").otherwise(F.col("id")).alias("id"),
        F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"),
        F.concat(F.lit('say "'), "evidence_text", F.lit('",\n')).alias("evidence_text"),
        F.nullif(F.trim("expected_label"), F.lit("")).alias("expected_label"),
    )


@query("read_records", f"""
    WITH {lift.CUSTOMER_RECORDS_SQL}
    SELECT CAST(CASE WHEN seq % 5 <> 0 THEN id END AS VARCHAR) AS id, '  ' || name || ' ' AS name,
        'say "' || evidence_text || '",' || chr(10) AS evidence_text,
        CASE WHEN seq % 3 <> 2 THEN nullif(trim(expected_label), '') END AS expected_label FROM raw_records""")
def read_records(spark, sf_dir):
    """Records written as CSV with three different headers into one folder, and read back."""
    rows = _csv_rows(spark, sf_dir)
    path = new_table_path(spark, "records-csv")
    headers = [
        ["expected_label", "extra", "name", "id", "evidence_text"],
        ["id", "name", "evidence_text", "expected_label"], ["evidence_text", "id", "extra", "name"],
    ]
    for place, header in enumerate(headers):
        own = rows.filter(F.col("seq") % 3 == place).withColumn("extra", F.lit("x,y")).select(*header)
        own.write.mode("append").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    return REC.read_records(spark, path).drop("seq")


@query("results_csv_roundtrip", f"""
    WITH {lift.CUSTOMER_RECORDS_SQL}
    SELECT CASE WHEN seq % 5 = 0 THEN 'NA' ELSE id END AS id, '  ' || name || ' ' AS name,
        'say "' || evidence_text || '",' || chr(10) AS evidence_text,
        nullif(trim(expected_label), '') AS expected_label,
        CASE WHEN seq % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM raw_records""")
def results_csv_roundtrip(spark, sf_dir):
    """Padded cells, quotes and line breaks through the CSV export and a plain CSV reader."""
    path = new_table_path(spark, "results-csv")
    sinks.write_csv(_csv_rows(spark, sf_dir).withColumn("flag", F.col("seq") % 2 == 0).drop("seq"), path)
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


@query("validate_records", f"WITH {lift.CUSTOMER_RECORDS_SQL} SELECT * FROM valid")
def validate_records(spark, sf_dir):
    return REC.validate_records(lift.customer_records(spark, sf_dir))


@query("rejected_records", f"""
    WITH {lift.CUSTOMER_RECORDS_SQL} SELECT * FROM checked WHERE reject_reason IS NOT NULL""")
def rejected_records(spark, sf_dir):
    return REC.rejected_records(lift.customer_records(spark, sf_dir))


@query("seed_state", f"""
    WITH {lift.CUSTOMER_RECORDS_SQL}
    SELECT seq, id AS restaurant_id, name, expected_label, evidence_text AS raw_text,
        CAST(NULL AS VARCHAR) AS cleaned_text, CAST(NULL AS VARCHAR) AS prediction,
        CAST(NULL AS DOUBLE) AS confidence, '[]' AS evidence, CAST(NULL AS VARCHAR) AS reasoning,
        CAST(NULL AS VARCHAR) AS validation_status, false AS needs_review,
        CAST(NULL AS VARCHAR) AS error FROM valid""")
def seed_state(spark, sf_dir):
    valid = REC.validate_records(lift.customer_records(spark, sf_dir))
    return REC.seed_state(valid).withColumn("evidence", sinks.json_list(F.col("evidence")))


# Sequence numbers all over the 63 bits, none twice.
_SPREAD = 6_148_914_691_236_517_205


@query("limit_records", f"""
    WITH {lift.LINEITEM_RECORDS_SQL}, spread AS (SELECT CAST((CAST(seq AS HUGEINT) * {_SPREAD})
        % 9223372036854775807 AS BIGINT) AS seq, id, expected_label FROM valid)
    SELECT * FROM spread ORDER BY seq LIMIT 1000""")
def limit_records_(spark, sf_dir):
    valid = REC.validate_records(lift.lineitem_records(spark, sf_dir))
    wide = F.col("seq").cast("decimal(38,0)") * F.lit(_SPREAD).cast("decimal(19,0)")
    spread = valid.withColumn("seq", (wide % F.lit(2**63 - 1).cast("decimal(19,0)")).cast("long"))
    return limit_records(spread, 1000).select("seq", "id", "expected_label")


# Predictions with good and bad confidences, blank quotes and errors.
_CONFIDENCES = [0.92, 0.6, 0.599, 1.0, 0.0, 1.5, -0.1, None]
_QUOTES = [["a"], [], [" ", "\t"], ["", "b"]]


def _predictions(spark, sf_dir):
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    confidence = F.element_at(
        F.array(*[F.lit(c).cast("double") for c in _CONFIDENCES]), (key % 8 + 1).cast("int")
    )
    quotes = F.element_at(
        F.array(*[F.array(*map(F.lit, q)).cast("array<string>") for q in _QUOTES]),
        (F.col("l_partkey") % 4 + 1).cast("int"),
    )
    return lift.table(spark, sf_dir, "lineitem").select(
        key.alias("seq"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("restaurant_id"),
        TPL.pick(["yes", "no", "unknown", "yes", None], F.col("l_suppkey")).alias("prediction"),
        confidence.alias("confidence"), quotes.alias("evidence"),
        TPL.pick([None, None, None, None, None, "", "broken"], F.col("l_partkey") + key).alias("error"),
        TPL.pick(["yes", "no", "unknown", None], key + F.col("l_orderkey")).alias("expected_label"),
    )


_PREDICTIONS_SQL = f"""
    preds AS (SELECT l_orderkey * 8 + l_linenumber AS seq,
        'o' || CAST(l_orderkey AS VARCHAR) AS restaurant_id,
        {S.pick(['yes', 'no', 'unknown', 'yes', None], 'l_suppkey')} AS prediction,
        CAST(([0.92, 0.6, 0.599, 1.0, 0.0, 1.5, -0.1, NULL])[(l_orderkey * 8 + l_linenumber) % 8 + 1]
            AS DOUBLE) AS confidence,
        l_partkey % 4 IN (0, 3) AS quoted,
        {S.pick([None] * 5 + ['', 'broken'], 'l_partkey + l_orderkey * 8 + l_linenumber')} AS error,
        {S.pick(['yes', 'no', 'unknown', None], 'l_orderkey * 8 + l_linenumber + l_orderkey')}
            AS expected_label
        FROM lineitem),
    checks AS (SELECT *, coalesce(confidence BETWEEN 0 AND 1, false) AS conf_ok,
        prediction = 'unknown' OR quoted AS supported FROM preds)"""
_VALIDATED_SQL = f"""
    {_PREDICTIONS_SQL},
    graded AS (SELECT * REPLACE (CASE WHEN coalesce(error, '') = '' AND prediction IS NOT NULL
            AND coalesce(confidence, 0) NOT BETWEEN 0 AND 1
            THEN 'confidence is outside the range 0.0 to 1.0' ELSE error END AS error),
        CASE WHEN coalesce(error, '') <> '' OR prediction IS NULL
                OR coalesce(confidence, 0) NOT BETWEEN 0 AND 1 THEN 'failed'
             WHEN coalesce(confidence, 0) < 0.6 OR NOT supported THEN 'flagged' ELSE 'ok' END
            AS validation_status FROM checks),
    validated AS (SELECT *, validation_status <> 'ok' AS needs_review FROM graded)"""


@query("confidence_valid", f"WITH {_PREDICTIONS_SQL} SELECT seq, conf_ok AS ok FROM checks")
def confidence_valid(spark, sf_dir):
    return _predictions(spark, sf_dir).select("seq", R.confidence_valid(F.col("confidence")).alias("ok"))


@query("supporting_evidence", f"""
    WITH {_PREDICTIONS_SQL} SELECT seq, supported AS ok FROM checks WHERE prediction IS NOT NULL""")
def supporting_evidence(spark, sf_dir):
    return _predictions(spark, sf_dir).filter(F.col("prediction").isNotNull()).select(
        "seq", R.supporting_evidence(F.col("prediction"), F.col("evidence")).alias("ok")
    )


@query("needs_review", f"""
    WITH {_PREDICTIONS_SQL}
    SELECT seq, NOT conf_ok OR confidence < 0.6 OR NOT supported AS review FROM checks
    WHERE prediction IS NOT NULL""")
def needs_review(spark, sf_dir):
    review = R.needs_review(
        F.col("prediction"), F.col("confidence"), F.col("evidence"), C.DEFAULT_THRESHOLD
    )
    return _predictions(spark, sf_dir).filter(F.col("prediction").isNotNull()).select(
        "seq", review.alias("review")
    )


def _validated(spark, sf_dir):
    return validate_predictions(_predictions(spark, sf_dir))


@query("validate_predictions", f"""
    WITH {_VALIDATED_SQL}
    SELECT seq, prediction, validation_status, needs_review, error FROM validated""")
def validate_predictions_(spark, sf_dir):
    return _validated(spark, sf_dir).select(
        "seq", "prediction", "validation_status", "needs_review", "error"
    )


@query("route_records", f"""
    WITH {_VALIDATED_SQL} SELECT seq, CASE WHEN validation_status = 'failed' THEN 'failed'
        WHEN needs_review THEN 'needs_review' ELSE 'success' END AS route FROM validated""")
def route_records_(spark, sf_dir):
    return route_records(_validated(spark, sf_dir)).select("seq", "route")


@query("is_correct", f"""
    WITH {_VALIDATED_SQL} SELECT seq, CASE WHEN error IS NULL AND validation_status <> 'failed'
        THEN prediction = expected_label END AS is_correct FROM validated""")
def is_correct(spark, sf_dir):
    correct = R.is_correct(
        F.col("prediction"), F.col("expected_label"), F.col("error"), F.col("validation_status")
    )
    return _validated(spark, sf_dir).select("seq", correct.alias("is_correct"))


_EXPECTED_SQL = """
    expected AS (SELECT {0} AS id_, arg_max(expected_label, seq) AS expected_for_id FROM {1}
        WHERE expected_label IS NOT NULL GROUP BY {0})"""


@query("expected_label_join", f"""
    WITH {lift.LINEITEM_RECORDS_SQL}, {_EXPECTED_SQL.format('id', 'valid')}
    SELECT seq, id, expected_for_id FROM valid LEFT JOIN expected ON id = id_""")
def expected_label_join(spark, sf_dir):
    rows = lift.lineitem_records(spark, sf_dir)
    return join_expected(rows, "id").select("seq", "id", "expected_for_id")


def summary_sql(source: str) -> str:
    """Metrics over a CTE with one row for each record."""
    return f"""
    {_EXPECTED_SQL.format('restaurant_id', source)},
    judged AS (SELECT s.*, expected_for_id AS truth,
        error IS NOT NULL OR validation_status = 'failed' OR prediction IS NULL AS bad
        FROM {source} s LEFT JOIN expected ON restaurant_id = id_),
    counted AS (SELECT count(*) AS total_records, count(*) FILTER (bad) AS failure_count,
        count(*) FILTER (NOT bad AND truth IS NOT NULL) AS evaluated,
        count(*) FILTER (NOT bad AND prediction = truth) AS correct,
        count(*) FILTER (NOT bad AND prediction = 'yes' AND truth IS NOT NULL) AS said_yes,
        count(*) FILTER (NOT bad AND truth = 'yes') AS actual_yes,
        count(*) FILTER (NOT bad AND prediction = 'yes' AND truth = 'yes') AS true_yes,
        count(*) FILTER (NOT bad AND truth IS NOT NULL AND confidence < 0.6) AS low,
        count(*) FILTER (needs_review) AS review FROM judged)
    SELECT CASE WHEN evaluated > 0 THEN CAST(correct AS DOUBLE) / evaluated ELSE 0.0 END AS accuracy,
        CASE WHEN said_yes > 0 THEN CAST(true_yes AS DOUBLE) / said_yes ELSE 0.0 END AS precision_yes,
        CASE WHEN actual_yes > 0 THEN CAST(true_yes AS DOUBLE) / actual_yes ELSE 0.0 END AS recall_yes,
        said_yes - true_yes AS false_positives, actual_yes - true_yes AS false_negatives,
        low AS low_confidence_count, total_records, failure_count, review AS review_queue_count
    FROM counted"""


@query("evaluate", f"WITH {_VALIDATED_SQL}, {summary_sql('validated')}")
def evaluate_(spark, sf_dir):
    return evaluate(_validated(spark, sf_dir))


def state_sql(records_sql: str) -> str:
    """CTE ``state``: records after cleaning, keyword extraction and validation."""
    return f"""
    {records_sql},
    cleaned AS (SELECT *, {S.clean('evidence_text')} AS cleaned_text FROM valid),
    {S.classify_ctes('cleaned', 'cleaned_text')},
    state AS (SELECT seq, id AS restaurant_id, name, label AS prediction, confidence,
        {S.json_list('quotes')} AS evidence, reasoning,
        CASE WHEN confidence < 0.6 OR (label <> 'unknown' AND len(quotes) = 0)
             THEN 'flagged' ELSE 'ok' END AS validation_status,
        confidence < 0.6 OR (label <> 'unknown' AND len(quotes) = 0) AS needs_review,
        label = expected_label AS is_correct, CAST(NULL AS VARCHAR) AS error, expected_label
        FROM cls)"""


_RESULTS = ", ".join(C.RESULT_COLUMNS)


def _job(spark, records, table):
    """Run the whole job and read one of the tables it wrote.

    Each test table is one file with one row group, so one task would read and clean it all.
    """
    out = new_table_path(spark, "run-job")
    run_job(records, out, spread=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{out}/{table}")


@query("results_rows", f"WITH {state_sql(lift.LINEITEM_RECORDS_SQL)} SELECT {_RESULTS} FROM state")
def results_rows(spark, sf_dir):
    return _job(spark, lift.lineitem_records(spark, sf_dir), "results")


@query("review_queue", f"""
    WITH {state_sql(lift.LINEITEM_RECORDS_SQL)} SELECT {_RESULTS} FROM state WHERE needs_review""")
def review_queue(spark, sf_dir):
    return _job(spark, lift.lineitem_records(spark, sf_dir), "review_queue")


@query("run_job", f"WITH {state_sql(lift.DOCUMENT_RECORDS_SQL)} SELECT {_RESULTS} FROM state")
def run_job_(spark, sf_dir):
    return _job(spark, lift.document_records(spark, sf_dir), "results")


@query("run_job_summary", f"WITH {state_sql(lift.CUSTOMER_RECORDS_SQL)}, {summary_sql('state')}")
def run_job_summary(spark, sf_dir):
    return _job(spark, lift.customer_records(spark, sf_dir), "summary")
