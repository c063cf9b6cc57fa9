from __future__ import annotations

import threading
import time

import pytest

from venuesift.operators.calls import Retry, in_order
from venuesift.plans import gathering as G
from venuesift.sources import catalog as CAT
from venuesift.sources.fetched import fetched_source


def test_results_keep_the_order_and_few_calls_run_at_once():
    running, most, lock = 0, 0, threading.Lock()

    def call(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (i % 5))
        with lock:
            running -= 1
        if i % 7 == 3:
            raise ValueError(f"no {i}")
        return i * i

    got = list(in_order(call, ((i,) for i in range(60)), 4))
    assert got == [(None, f"no {i}") if i % 7 == 3 else (i * i, None) for i in range(60)]
    assert 1 < most <= 4


def test_items_are_taken_as_they_are_needed():
    taken = []

    def items():
        for i in range(1000):
            taken.append(i)
            yield (i,)

    stream = in_order(lambda i: i, items(), 3)
    assert next(stream) == (0, None) and len(taken) <= 7


@pytest.mark.parametrize(("tries", "failures", "result"), [(1, 1, (None, "1")), (3, 2, ("done", None)), (3, 9, (None, "3"))])
def test_calls_are_tried_again(tries, failures, result):
    seen = 0

    def call():
        nonlocal seen
        seen += 1
        if seen <= failures:
            raise OSError(str(seen))
        return "done"

    assert Retry(tries, wait=0.0).call(call) == result
    seen = 0
    assert Retry(5, wait=0.0, worth=lambda failure: False).call(call)[1] == "1"


def venues(spark):
    return spark.createDataFrame(
        [(1, "Good", "Rome"), (2, "Bad", "Rome"), (3, "Empty", "Rome"), (4, "Good", "Rome"), (5, "Odd", "Oslo")],
        "seq long, name string, city string",
    )


def client():
    """Nested, so that it goes to the workers with the job."""
    def make_fetch():
        def fetch(name, city):
            if name == "Bad":
                raise TimeoutError(f"{city} timed out")
            if name == "Odd":
                return [{"snippet": "first"}, {"url": "u"}]
            return [] if name == "Empty" else [{"snippet": "Seats", "url": "http://a"}, {"snippet": "Patio", "reliability": "high"}]

        return fetch

    return make_fetch


def test_a_failing_venue_does_not_touch_others(spark):
    source = fetched_source(venues(spark), "live", "maps", client())
    rows = sorted(tuple(r) for r in source.rows.select("match_key", "item_pos", "url", "snippet", "reliability").collect())
    assert rows == [("good|rome", 0, "http://a", "Seats", "medium"), ("good|rome", 1, None, "Patio", "high")]
    assert sorted((r.match_key, r.error) for r in source.errors.collect()) == [
        ("bad|rome", "Rome timed out"), ("odd|oslo", "item without a text snippet")
    ]


def test_a_raising_source_in_a_gather_job(spark):
    """Evidence of other sources is kept beside the error, as for any source."""
    live = fetched_source(venues(spark), "live", "maps", client(), tasks=2)
    search = CAT.static_source("static_search", "search", spark.createDataFrame(
        [("bad|rome", 0, None, "Outdoor terrace")], "key string, pos int, url string, snippet string"))
    catalog = CAT.build_catalog(spark, search=search, live={"live": live}, live_source="live")
    rows, errors = G.matched_evidence(G.venues(venues(spark)), catalog)
    assert {(r.name, r.source_name) for r in rows.collect()} == {("Good", "live"), ("Bad", "static_search")}
    assert {(r.name, r.source_name, r.error) for r in errors.collect()} == {
        ("Bad", "live", "Rome timed out"), ("Odd", "live", "item without a text snippet")}
