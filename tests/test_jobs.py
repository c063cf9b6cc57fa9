"""Both jobs end to end on small inputs."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from venuesift import contracts as C
from venuesift.operators.replies import hook_extract
from venuesift.plans.batch import process_records, run_job
from venuesift.plans.gathering import job_results, job_review_queue, run_gather_job
from venuesift.sources import catalog as CAT
from venuesift.sources import places as PL
from venuesift.sources import sinks
from venuesift.sources.records import read_records

ROWS = [
    # id, text, label, expected outcome: prediction, confidence, status, correct
    ("v1", "Lunch on our leafy patio, all year. Ask for rugs.", "yes", "yes", 0.92, "ok", "True"),
    ("v2", "A rooftop bar!\nMENU\n---", "yes", "yes", 0.92, "ok", "True"),
    ("v3", "Tapas bar. We do not offer the sidewalk to groups.", "no", "no", 0.91, "ok", "True"),
    ("v4", "<p>Jazz in a basement</p>", "yes", "no", 0.91, "ok", "False"),
    ("v5", "Brunch outdoor, weather permitting, else inside.", "unknown", "unknown", 0.55, "flagged", "True"),
    ("v6", "In May we do not have outdoor service; the patio opens on request.", "unknown", "unknown", 0.45, "flagged", "True"),
    ("v7", "Noodles, \"spicy\".", "unknown", "unknown", 0.35, "flagged", "True"),
    ("v8", "Steaks — and wine.", "", "unknown", 0.35, "flagged", None),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "venues.csv"
    frame = pd.DataFrame([(r[0], f"Venue {r[0]}", r[1], r[2]) for r in ROWS] + [("", "x", "y", ""), ("v9", "x", "y", "maybe")],
                         columns=C.RECORD_FIELDS)
    frame.to_csv(path, index=False)
    return read_records(spark, str(path))


def read_csv(folder):
    parts = sorted(folder.glob("part-*.csv"))
    return pd.concat([pd.read_csv(p, dtype=str) for p in parts], ignore_index=True)


def test_records_job(spark, records, tmp_path):
    summary = run_job(records, str(tmp_path / "out"), csv=True).first().asDict()
    assert summary == {
        "accuracy": 6 / 7, "precision_yes": 1.0, "recall_yes": 2 / 3, "false_positives": 0,
        "false_negatives": 1, "low_confidence_count": 3, "total_records": 8, "failure_count": 0,
        "review_queue_count": 4,
    }
    results = read_csv(tmp_path / "out" / "results_csv")
    assert list(results.columns) == C.RESULT_COLUMNS
    assert list(results.restaurant_id) == [r[0] for r in ROWS]
    for row, (_, text, _, label, confidence, status, correct) in zip(results.itertuples(), ROWS):
        assert (row.prediction, float(row.confidence), row.validation_status) == (label, confidence, status)
        assert (None if pd.isna(row.is_correct) else row.is_correct) == correct
        assert row.needs_review == str(status != "ok") and pd.isna(row.error)
    assert json.loads(results.evidence[0]) == ["Lunch on our leafy patio, all year."]
    assert json.loads(results.evidence[1]) == ["A rooftop bar!"]
    assert json.loads(results.evidence[3]) == ["Jazz in a basement"]
    queue = read_csv(tmp_path / "out" / "review_queue_csv")
    assert list(queue.restaurant_id) == ["v5", "v6", "v7", "v8"]
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected"))
    assert sorted(r.reject_reason for r in rejected.collect()) == [
        "expected_label is not a known label", "id is missing"]


def test_quotes_are_written_as_text_once_before_any_sort(spark, records, tmp_path, monkeypatch):
    sorted_plans = []

    def in_order(rows):
        sorted_plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return own(rows)

    own = getattr(sinks, "in_order", None)
    monkeypatch.setattr(sinks, "in_order", in_order, raising=False)
    run_job(records, str(tmp_path / "out"))
    state = spark.read.parquet(str(tmp_path / "out" / "state"))
    assert dict(state.dtypes)["evidence"] == "string" and dict(state.dtypes)["is_correct"] == "boolean"
    assert len(sorted_plans) == 2 and not any("transform(" in plan for plan in sorted_plans)
    queue = [r.restaurant_id for r in spark.read.parquet(str(tmp_path / "out" / "review_queue")).collect()]
    assert sorted(queue) == ["v5", "v6", "v7", "v8"]


def test_limit_counts_valid_records(records):
    assert [r.restaurant_id for r in process_records(records, limit=3).orderBy("seq").collect()] == ["v1", "v2", "v3"]
    assert process_records(records, limit=0).count() == 0


def test_one_failing_call_does_not_stop_the_job(records, tmp_path):
    def make():
        def complete(system, user):
            if "rooftop" in user:
                raise RuntimeError("down")
            if "patio" in user:
                return "not json"
            return '{"label": "no", "confidence": 0.9, "evidence": ["q"], "reasoning": "r"}'

        return complete

    summary = run_job(records, str(tmp_path / "out"), extract=hook_extract(make)).first()
    assert (summary.total_records, summary.failure_count) == (8, 3)
    rows = {r.restaurant_id: r for r in records.sparkSession.read.parquet(str(tmp_path / "out/results")).collect()}
    assert rows["v2"].error == "down" and rows["v2"].validation_status == "failed"
    assert "repair retry" in rows["v1"].error and rows["v3"].prediction == "no"


@pytest.fixture()
def requests(spark):
    return spark.createDataFrame(
        [(10, "Pier House", "Oslo"), (11, "Cellar", "Rome"), (12, "Pier House", "Oslo"), (13, "Empty", "Bern")],
        "seq long, name string, city string")


@pytest.fixture()
def catalog(spark, tmp_path):
    def save(name, content):
        (tmp_path / f"{name}.json").write_text(json.dumps(content), encoding="utf-8")

    save("search", {"pier house|oslo": [{"url": "https://s.test/1", "snippet": "A terrace by the water."}],
                    "cellar|rome": [{"url": "x"}]})
    save("reviews", {"pier house|oslo": [{"url": None, "snippet": "a  TERRACE by the water."},
                                         {"snippet": "We liked the deck."}],
                     "cellar|rome": [{"snippet": "Dark basement vault."}]})
    return lambda **more: CAT.static_catalog(spark, str(tmp_path), **more)


def test_gather_job(spark, requests, catalog, tmp_path):
    out = run_gather_job(requests, catalog(), str(tmp_path / "out"), csv=True)
    rows = {(r.name, r.city): r for r in out.collect()}
    assert out.columns == C.GATHER_COLUMNS and out.count() == 4
    pier = rows["Pier House", "Oslo"]
    assert pier.restaurant_id == "pier-house-oslo" and pier.prediction == "yes" and pier.confidence == 0.92
    assert json.loads(pier.evidence) == ["[search] https://s."]
    assert json.loads(pier.source_evidence_snippets) == ["A terrace by the water.", "We liked the deck."]
    assert pier.source_urls == '["https://s.test/1", null]' and pier.source_types == '["search", "review"]'
    assert pier.gather_errors == "[]" and not pier.needs_review and pier.error is None
    cellar = rows["Cellar", "Rome"]
    assert (cellar.prediction, cellar.gather_errors) == ("no", '["static_search: \'snippet\'"]')
    empty = rows["Empty", "Bern"]
    assert empty.error == "No evidence gathered from any source" and empty.validation_status == "failed"
    assert empty.needs_review and empty.prediction is None and empty.evidence == "[]"
    ordered = read_csv(tmp_path / "out" / "results_csv")
    assert list(ordered.name) == ["Pier House", "Cellar", "Pier House", "Empty"]
    assert list(read_csv(tmp_path / "out" / "review_queue_csv").name) == ["Empty"]


def test_returned_results_are_not_sorted_with_their_lists(spark, requests, catalog, tmp_path):
    out = run_gather_job(requests, catalog(), str(tmp_path / "out"))
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    listed = [r.name for r in job_results(spark, str(tmp_path / "out")).collect()]
    assert listed == ["Pier House", "Cellar", "Pier House", "Empty"] and sorted(listed) == sorted(r.name for r in out.collect())


def test_a_source_that_fails_as_a_whole_is_told_to_every_venue(spark, requests, catalog, tmp_path):
    (tmp_path / "maps.json").write_text("{broken", encoding="utf-8")
    out = run_gather_job(requests, catalog(), str(tmp_path / "out"))
    told = {r.name: json.loads(r.gather_errors) for r in out.collect()}
    bad = "static_maps: catalog is not valid JSON"
    assert told == {"Pier House": [bad], "Cellar": ["static_search: 'snippet'", bad], "Empty": [bad]}


def test_gather_with_places_in_the_maps_role(spark, requests, catalog, tmp_path):
    searches = spark.createDataFrame(
        [("Empty, Bern", '{"places": [{"id": "e"}]}', None), ("Cellar, Rome", None, "boom")],
        "match_key string, response string, call_error string")
    details = spark.createDataFrame(
        [("e", '{"outdoorSeating": true, "googleMapsUri": "https://m.test/e"}', None)],
        "place_id string, response string, call_error string")
    live = {"places": PL.places_source("places", searches, details)}
    out = run_gather_job(requests, catalog(live=live, live_source="places"), str(tmp_path / "out"))
    rows = {r.name: r for r in out.collect()}
    assert rows["Empty"].prediction == "yes" and rows["Empty"].source_types == '["maps"]'
    assert rows["Cellar"].gather_errors == '["static_search: \'snippet\'", "places: boom"]'


def test_the_gate_spares_the_model(requests, catalog, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def make():
        import os
        import uuid

        def complete(system, user):
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return '{"label": "yes", "confidence": 0.9, "evidence": ["q"], "reasoning": "r"}'

        return complete

    out = run_gather_job(requests, catalog(), str(tmp_path / "out"), extract=hook_extract(make, key="venue"))
    rows = {r.name: r for r in out.collect()}
    assert rows["Empty"].error == "No evidence gathered from any source"
    assert rows["Pier House"].prediction == rows["Cellar"].prediction == "yes"
    assert len(list(log.iterdir())) == 2


def test_requests_without_name_or_city_are_set_aside(spark, requests, catalog, tmp_path):
    more = requests.unionByName(spark.createDataFrame(
        [(20, None, "Oslo"), (21, "Pier House", None), (22, None, None)], requests.schema))
    out = run_gather_job(more, catalog(), str(tmp_path / "out"))
    assert out.count() == 4 and out.filter("validation_status is null").count() == 0
    aside = spark.read.parquet(str(tmp_path / "out" / "rejected"))
    assert sorted((r.seq, r.reject_reason) for r in aside.collect()) == [
        (20, "name is missing"), (21, "city is missing"), (22, "name is missing")]


def test_evidence_is_kept_flat_and_ranked(spark, requests, catalog, tmp_path):
    run_gather_job(requests, catalog(), str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out" / "evidence")).filter("name = 'Pier House'").orderBy("rank")
    assert [(r["rank"], r.source_type, r.snippet) for r in kept.collect()] == [
        (1, "search", "A terrace by the water."), (2, "review", "We liked the deck.")]
    assert [r.name for r in job_review_queue(spark, str(tmp_path / "out")).collect()] == ["Empty"]


def test_a_queue_in_no_order_is_not_sorted_with_its_lists(spark, requests, catalog, tmp_path):
    run_gather_job(requests, catalog(), str(tmp_path / "out"))
    queue = job_review_queue(spark, str(tmp_path / "out"), in_order=False)
    assert "rangepartitioning" not in queue._jdf.queryExecution().toString()
    assert queue.collect() == job_review_queue(spark, str(tmp_path / "out")).collect()


def test_rejected_records_do_not_reach_the_model(records, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def make():
        import os
        import uuid

        def complete(system, user):
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return '{"label": "yes", "confidence": 0.9, "evidence": ["q"], "reasoning": "r"}'

        return complete

    run_job(records, str(tmp_path / "out"), extract=hook_extract(make, partitions=3))
    assert len(list(log.iterdir())) == len(ROWS)


def test_padded_cells_survive_the_export(spark, tmp_path):
    frame = spark.createDataFrame([("  a ", 'q "x"\nline ', True), (None, "", False)], "name string, error string, needs_review boolean")
    sinks.write_csv(frame, str(tmp_path / "out"))
    got = read_csv(tmp_path / "out").sort_values("needs_review", ascending=False)
    assert got.iloc[0].tolist() == ["  a ", 'q "x"\nline ', "True"]
    assert got.iloc[1].isna().tolist() == [True, True, False]
