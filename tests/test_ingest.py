import json

import pytest
from pyspark.sql import functions as F

from trailmark.sources import ingest

CLASSIC = {"trajectory": [{"action": "grep xi", "observation": "a/b/c.py:1", "thought": "t", "response": "r", "state": {"diff": "d1"}}, {"action": None, "observation": None, "thought": None, "response": "only said"}, {"action": "pytest test_i.py", "observation": "1 failed, 2 passed", "thought": None}, {"action": "python x.py", "observation": "Traceback (most recent call last):"}], "info": {"exit_status": "submitted", "submission": "diff --git", "model_stats": {"tokens_sent": 9999, "tokens_received": 111, "api_calls": 4}}}
MINI = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "task"}, {"role": "assistant", "content": "THOUGHT: find the bug\n```bash\ngrep -r foo /x\n```"}, {"role": "user", "content": "out"}, {"role": "assistant", "content": "just words"}], "info": {}}
CALLS = [{"role": "user", "content": "task"}, {"role": "assistant", "content": [{"type": "text", "text": "Look.\n<function=execute_bash>\n<parameter=command>cat a/b.py</parameter>\n</function>"}]}, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "body"}]}]}]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    for name, d in (("org__classic-1.traj", CLASSIC), ("org__mini-2.json", MINI), ("calls.json", CALLS), ("odd.json", {"x": 1})):
        (at / name).write_text(json.dumps(d))
    return ingest.read_raw(spark, str(at))


def test_layouts_and_outcomes(raw):
    got = {r["task_id"]: r for r in ingest.outcomes(raw).collect()}
    assert {k: r["layout"] for k, r in got.items()} == {"org__classic-1": "classic_traj", "org__mini-2": "mini_swe_agent", "calls": "openhands", "odd": "unknown"}
    assert got["org__classic-1"]["submission_present"] and got["org__classic-1"]["tokens_sent"] == 9999
    assert got["org__mini-2"]["submission_present"] is None and got["org__mini-2"]["tokens_sent"] is None


def test_events(raw):
    rows = ingest.events(raw, "solver_A").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["event_index"]):
        by.setdefault(r["task_id"], []).append(r)
    assert set(by) == {"org__classic-1", "org__mini-2", "calls"}
    for events in by.values():
        assert [e["event_index"] for e in events] == list(range(len(events)))
        assert all(e["input_tokens"] is None for e in events)
    c = by["org__classic-1"]
    assert [e["normalized_action_type"] for e in c] == ["SEARCH", "PLAN", "TEST", "TOOL_ERROR"]
    assert c[0]["file_paths"] == ["a/b/c.py"] and c[0]["patch_delta_hash"] and c[2]["test_result"] == "MIXED" and c[0]["repo"] == "org" and c[0]["trace_id"] == "org__classic-1@solver_A"
    m = by["org__mini-2"]
    assert [e["normalized_action_type"] for e in m] == ["SEARCH", "PLAN"] and m[0]["tool_output_hash"]
    o = by["calls"]
    assert o[0]["tool_name"] == "execute_bash" and o[0]["normalized_action_type"] == "READ" and o[0]["repo"] is None
    assert ingest.steps(raw).where("task_id = 'calls'").first()["observation"] == "body"
    text = {r["trace_id"]: r["text"] for r in ingest.render(ingest.events(raw, "solver_A"), 1).collect()}
    assert text["calls@solver_A"] == "[0] READ | cat a/b.py"


def test_reports_and_fingerprints(spark):
    reports = spark.createDataFrame([("a", json.dumps({"completed_ids": ["1", "2"], "resolved_ids": ["2"]})), ("b", json.dumps({"completed_ids": ["1"], "resolved_instances": ["1"]}))], "tag string, raw string")
    assert sorted(map(tuple, ingest.grades(reports).collect())) == [("a", "1", False), ("a", "2", True), ("b", "1", True)]
    flags = spark.createDataFrame([('{"resolved": true}', "i"), ('{"i": {"resolved": false}}', "i"), ('{"k": {"resolved": true}}', "i"), ("{}", "i")], "raw string, i string")
    assert [r[0] for r in flags.select(ingest.resolved_flag(F.col("raw"), F.col("i"))).collect()] == [True, False, True, None]
    f = spark.createDataFrame([("x" * 3000, "t1", 1), ("x" * 2500, "t2", 2), ("y", "t3", 3)], "first_user_text string, task_id string, load_order int")
    assert sorted(r["task_id"] for r in ingest.fingerprints(f).collect()) == ["t2", "t3"]


def test_free_text_json_and_transcripts(spark):
    texts = ['say ```json\n{"a": 1}\n``` end', 'x {"b": [1, 2]} and [3]', "[1, 2]", "none", None, '{"broken": }']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ingest.extract_json(F.col("t"))).collect()] == ['{"a": 1}', '{"b": [1, 2]}', "[1, 2]", None, None, None]
    t = spark.createDataFrame([("a", "intro\n[0] SEARCH | grep x\n  thought: why\n  obs: found\n[3] EDIT | edit y\n")], "id string, text string")
    rows = sorted(map(tuple, ingest.transcript_rows(t).collect()))
    assert rows == [("a", 0, "SEARCH", "grep x", "why", "found"), ("a", 3, "EDIT", "edit y", "", "")]


def test_ledger_skips_what_does_not_parse(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"task_id": "a", "method": "m", "call_index": 1}\n\nbroken\n{"task_id": "b"}\n')
    assert sorted(r["task_id"] for r in ingest.read_ledger(spark, str(tmp_path)).collect()) == ["a", "b"]
