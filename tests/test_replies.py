from __future__ import annotations

import json

from venuesift.operators.replies import collect_replies, extract_with_repair, parse_response


def reply(**changes):
    fields = {"label": "yes", "confidence": 0.9, "evidence": ["q"], "reasoning": "r", **changes}
    return json.dumps({k: v for k, v in fields.items() if v != "absent"})


GOOD = [
    reply(), f"```json\n{reply()}\n```", f"Sure:\n```\n{reply()}\n```\nbye", f"  {reply()}\n",
    reply(extra=1), reply(evidence=[]), reply(confidence=1), reply(confidence=0), reply(confidence="0.9"),
    reply(confidence=True), reply(reasoning=""), '{"label": "no", ' + reply()[1:], reply(evidence=["é\n\"x\""]),
    '{"label":"yes","confidence":9e-1,"evidence":[],"reasoning":"\\u00e9"}',
]
BAD_SCHEMA = [
    reply(label="maybe"), reply(label=None), reply(label="absent"), reply(confidence=1.5),
    reply(confidence=-0.1), reply(confidence=None), reply(confidence="high"), reply(confidence="0.9f"),
    reply(confidence=[0.9]), reply(confidence="absent"), reply(evidence="q"), reply(evidence=None),
    reply(evidence=["q", 1]), reply(evidence=["q", None]), reply(evidence="absent"), reply(evidence={"a": "b"}),
    reply(reasoning=1), reply(reasoning="absent"), f"[{reply()}]", '"text"', "1", "null", "{}",
    reply(confidence="NaN"), reply(label=["yes"]),
]
NOT_JSON = [
    "", "no json", reply() + " thanks", reply() + "}} x", reply() + "}] x", reply() + ',{"v": 1}',
    reply() + ',"__end":1} x', reply() + ',1] x [', reply() + "]", "{'label': 'yes'}", reply()[:-1],
    f'{reply()},"v":{reply()}', "[1, 2", f"```json\n{reply()} x\n```", "NaN", "\x01",
]


def test_parsing(spark):
    texts = GOOD + BAD_SCHEMA + NOT_JSON
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    rows = parse_response(frame, "reply").orderBy("i").collect()
    for text, row in zip(texts, rows):
        assert row.parsed.is_json == (text not in NOT_JSON), text
        assert row.parsed.schema_ok == (text in GOOD), text
        assert (row.parsed.extraction is not None) == (text in GOOD), text
    assert rows[9].parsed.extraction.confidence == 1.0
    assert rows[11].parsed.extraction.label == "yes"
    assert rows[12].parsed.extraction.evidence == ["é\n\"x\""]


def test_missing_reply(spark):
    frame = spark.createDataFrame([(None,)], "reply string")
    parsed = parse_response(frame, "reply").first().parsed
    assert (parsed.is_json, parsed.schema_ok, parsed.extraction) == (False, False, None)


STATE = "seq long, cleaned_text string, error string"


def outcome(spark, attempts, cleaned="text"):
    state = spark.createDataFrame([(1, cleaned, None)], STATE)
    replies = spark.createDataFrame(
        [(1, n, text, failure) for n, (text, failure) in enumerate(attempts, start=1)],
        "seq long, attempt int, reply string, call_error string",
    )
    return extract_with_repair(state, replies).first()


def test_first_reply_counts(spark):
    row = outcome(spark, [(reply(), None), (reply(label="no"), None)])
    assert (row.prediction, row.confidence, row.evidence, row.reasoning, row.error) == ("yes", 0.9, ["q"], "r", None)


def test_repair(spark):
    row = outcome(spark, [("junk", None), (reply(label="no", confidence=0.88), None)])
    assert (row.prediction, row.confidence, row.error) == ("no", 0.88, None)


def test_failed_repair(spark):
    row = outcome(spark, [("junk", None), ("junk", None)])
    assert row.prediction is None and row.confidence is None and row.evidence == []
    assert row.error.startswith("Failed to parse extraction JSON after repair retry: ")


def test_call_errors(spark):
    assert outcome(spark, [(None, "down"), (reply(), None)]).error == "down"
    assert outcome(spark, [(None, "down"), (reply(), None)]).prediction is None
    assert outcome(spark, [("junk", None), (None, "down")]).error == "down"


def test_uncleaned_rows_are_not_read(spark):
    row = outcome(spark, [(reply(), None)], cleaned=None)
    assert row.prediction is None and row.error == "Missing cleaned_text: run preprocessing first."


def test_hook_calls_once_and_repairs_once(spark, tmp_path):
    log = str(tmp_path)

    def make():
        import os
        import uuid

        def complete(system, user):
            repair = "You answered:" in user
            word = "again" if repair else "first"
            kind = next(k for k in ("good", "fixed", "never", "broken") if f"kind-{k}" in user)
            open(os.path.join(log, f"{kind}-{word}-{uuid.uuid4().hex}"), "w").close()
            if kind == "broken":
                raise RuntimeError("down")
            if kind == "good" or (kind == "fixed" and repair):
                return '{"label": "yes", "confidence": 0.9, "evidence": ["q"], "reasoning": "r"}'
            return "junk {unclosed"

        return complete

    state = spark.createDataFrame(
        [(i, f"kind-{k} {{braces}}" if k else None, None)
         for i, k in enumerate(["good", "fixed", "never", "broken", None] * 5)], STATE)
    replies = collect_replies(state, make)
    done = extract_with_repair(state, replies)
    done.count()
    rows = {r.seq: r for r in done.collect()}
    assert [rows[i].prediction for i in range(5)] == ["yes", "yes", None, None, None]
    assert rows[3].error == "down" and "repair retry" in rows[2].error and "Missing" in rows[4].error
    calls = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert calls == sorted(
        ["good-first", "fixed-first", "fixed-again", "never-first", "never-again", "broken-first"] * 5)


def test_a_second_run_only_asks_for_what_is_missing(spark, tmp_path):
    log = str(tmp_path / "log")
    (tmp_path / "log").mkdir()

    def make():
        import os
        import uuid

        def complete(system, user):
            open(os.path.join(log, uuid.uuid4().hex), "w").close()
            return "junk" if "odd" in user else '{"label": "yes", "confidence": 0.9, "evidence": [], "reasoning": ""}'

        return complete

    def run(n):
        state = spark.createDataFrame([(i, "odd" if i % 2 else "even", None) for i in range(n)], STATE)
        return collect_replies(state, make, path=str(tmp_path / "replies"), partitions=2, waves=3).count()

    calls = lambda: len(list((tmp_path / "log").iterdir()))
    assert (run(10), calls()) == (15, 15)
    assert (run(10), calls()) == (15, 15)
    assert (run(14), calls()) == (21, 21)


def test_an_older_error_gives_way(spark):
    state = spark.createDataFrame([(1, None, "older")], STATE)
    replies = spark.createDataFrame([], "seq long, attempt int, reply string, call_error string")
    assert extract_with_repair(state, replies).first().error.startswith("Missing cleaned_text")
