"""Segments, decisions, requests, audits and sinks against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trailmark.operators import audits, ledger, sequence, statistics, studies
from trailmark.operators import evidence as ev
from trailmark.sources import sinks
from trailmark.streaming import requests, trial


def test_scanners_against_re(spark):
    texts = ["def run(x):\n  class A: pass\nErrors in lib/a.py and lib/a.py\n  File \"a\"\nFAILED test_one test_one git ls 0xdeadbeef", "", None, "see src/x.toml; python -m pytest"]
    got = ev.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "i").orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        want = (len(set(re.findall(ev.PATHS, t))), len(set(re.findall(ev.FUNCTIONS, t))), len(set(re.findall(ev.CLASSES, t))), len(re.findall(ev.ERRORS, t)), len(re.findall(ev.TRACEBACK_LINES, t)), len(set(re.findall(ev.TESTS, t))), len(re.findall(ev.SHELL, t)), bool(re.search(ev.TRANSIENT, t)))
        assert tuple(r[c] for c in ("n_paths", "n_funcs", "n_classes", "n_errors", "n_traceback_lines", "n_tests", "n_shell", "transient_state")) == want


def test_redundancy_against_sets(spark):
    rng = random.Random(1)
    pool = [f"line number {k} with enough text" for k in range(12)] + ["short", "   padded line number one   ", ""]
    obs = [(k, i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for k in range(4) for i in range(6)] + [(9, 0, None), (9, 1, "")]
    got = {(r["k"], r["i"]): r for r in ev.observation_strata(ev.available(ev.redundancy(spark.createDataFrame(obs, "k int, i int, text string"), "k", "i", "text"))).collect()}
    assert len(got) == len(obs)
    for k, i, text in obs:
        text = text or ""
        lines = [x.strip() for x in text.split("\n") if len(x.strip()) >= 12]
        prior = {x.strip() for kk, ii, t in obs if kk == k and ii < i for x in (t or "").split("\n")}
        heads = {(t or "").split("\n")[0].strip() for kk, ii, t in obs if kk == k and ii < i}
        dup = sum(x in prior for x in lines)
        head = text.split("\n")[0].strip()
        r = got[k, i]
        assert (r["eligible"], r["dup"]) == (len(lines), dup)
        assert bool(r["same_head"]) == (head in heads and len(head) > 20)
        frac = dup / max(len(lines), 1)
        assert ("A_exact_redundancy" in r["strata"]) == (frac > 0.4 and dup >= 5) and ("F_hard_negative" in r["strata"]) == (0.2 < frac < 0.8 and dup >= 3)


def test_memo_patterns(spark):
    kinds = ["READ", "EDIT", "OTHER", "TEST", "SEARCH", "SEARCH", "EDIT"]
    rows = [(1, i, k, v) for i, (k, v) in enumerate(zip(kinds, [90, 1, 1, 1, 0, 0, 1], strict=True))] + [(2, 0, "EDIT", 1)]
    kind, v = F.col("kind"), F.col("v")
    got = {r["k"]: r for r in ev.memo(spark.createDataFrame(rows, "k int, i int, kind string, v int"), "k", "i", "kind", v >= 50, (kind == "OTHER"), kind == "EDIT", (kind == "SEARCH") & (v == 0), v < 0).collect()}
    one = got[1]
    assert (one["narrowed"], one["edit_failures"], one["failures_from"], one["failures_to"], one["empty_searches"], one["empties_from"], one["empties_to"], one["edit_test_at"]) == (1, 2, 1, 6, 2, 4, 5, 0)
    assert (got[2]["failures_from"], got[2]["edit_test_at"], got[2]["environment_at"]) == (None, None, None)


def test_labels_and_calls(spark):
    shapes = [("A", "A"), ('"A"', "A"), ('{"label": "A", "severity": 1}', "A"), ('{"l2": "A"}', "A"), ('{"A": "high"}', "A"), ('{"x": 1, "y": 2}', None), (None, None)]
    got = [r["x"] for r in spark.createDataFrame([(i, s) for i, (s, _) in enumerate(shapes)], "i int, s string").orderBy("i").select(ev.label_id(F.col("s")).alias("x")).collect()]
    assert got == [w for _, w in shapes]
    rows = [("a", "user"), ("a", "assistant"), ("b", "user"), ("b", "user"), ("b", "user"), ("c", "system"), ("c", "user"), ("c", "assistant"), ("c", "user")]
    assert {r["k"]: r["call_class"] for r in ev.call_kind(spark.createDataFrame(rows, "k string, role string"), "k", "role").collect()} == {"a": "internal_setup", "b": "internal_setup", "c": "main_agent_call"}
    c = spark.createDataFrame([("No replacement was performed",), ("File created",), ("",), (None,)], "t string").select(ev.edit_outcome(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in c] == ["failed", "applied", None, None]


@pytest.mark.parametrize(("mode", "arm", "any_due"), [("randomize", None, True), ("noop_only", "NO_OP", True), ("dedup_only", "LINEDEDUP", True), ("log_only", None, False)])
def test_request_modes(spark, mode, arm, any_due):
    long = "\n".join(f"a line of some length, number {i}" for i in range(80))
    rows = [(k, i, t, i > 1) for k in ("known", "new", "done") for i, t in enumerate(["task", "plan", long, "more", long])]
    m = spark.createDataFrame(rows, "k string, i int, t string, obs boolean")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    got = {r["k"]: r for r in requests.event_records(m, keys("known", "done"), "k", "i", "t", "obs", mode, keys("done")).collect()}
    assert got["known"]["randomise"] == any_due and got["known"]["assignment"] == (arm if any_due else None) and got["known"]["stratum"] == "HIGH_REDUNDANCY"
    assert not got["done"]["randomise"] and not got["new"]["randomise"] and got["new"]["provider_error"] == "unknown_task_fingerprint" and got["new"]["segment_chars"] == 0


def test_outcomes_fail_closed(spark):
    kind = "e int, input_tokens double, cache_read_tokens double, cache_creation_tokens double, output_tokens double"
    got = requests.attach_outcome(spark.createDataFrame([(1, 100.0, 1000.0, 50.0, 20.0), (2, None, None, None, None), (3, 10.0, None, None, None)], kind)).orderBy("e").collect()
    assert [(r["effective_cost"], r["infrastructure_failure"]) for r in got] == [(362.5, False), (None, True), (10.0, False)]


def test_a_used_up_plan_is_an_error(spark):
    plan = trial.plan(spark, 1, ["HIGH"], 1)
    rows = [(f"t{i}", f"h{i}", "HIGH", True, i) for i in range(5)]
    kind = "task_id string, request_hash string, stratum string, available boolean, ts long"
    assert len(trial.batch_twin(spark.createDataFrame(rows[:4], kind), plan)[1].collect()) == 4
    with pytest.raises(Exception, match="used up"):
        trial.batch_twin(spark.createDataFrame(rows, kind), plan)[1].collect()


def test_slots_follow_arrival(spark):
    plan = trial.plan(spark, 1, ["HIGH"], 2)
    rows = [(f"t{9 - i}", f"h{i}", "HIGH", True, i) for i in range(6)]
    got = trial.batch_twin(spark.createDataFrame(rows, "task_id string, request_hash string, stratum string, available boolean, ts long"), plan)[1].collect()
    assert [r["task_id"] for r in sorted(got, key=lambda r: r["slot"])] == [r[0] for r in rows]


def test_clean_split_has_no_leaks(spark):
    rows = [(f"t{i}@{s}", f"t{i}", f"r{i % 12}", s) for i in range(60) for s in ("A", "E")]
    s = audits.split_by_group(spark.createDataFrame(rows, "trace string, task string, repo string, solver string"), "repo", "solver", "E").withColumn("base", F.col("trace"))
    assert {r["part"] for r in s.select("part").distinct().collect()} == {"train", "validation", "test", "model_transfer_test"}
    assert {r["audit"]: r["violations"] for r in audits.split_audit(s, "E").collect()} == dict.fromkeys(("trace_overlap", "task_overlap", "base_overlap", "held_out_in_train", "repo_transfer_overlap"), 0)
    leaks = spark.createDataFrame([("train", "a", "t", "b1", "A", "r"), ("test", "a", "t", "b1", "A", "q"), ("train", "c", "u", "b2", "E", "z"), ("repo_transfer_test", "d", "v", "b3", "A", "z")], "part string, trace string, task string, base string, solver string, repo string")
    assert all(r["violations"] == 1 for r in audits.split_audit(leaks, "E").collect())


def test_task_classes_by_hand(spark):
    def reps(task, control, sham, method, fired):
        return [(task, arm, i, bool(p), fired) for arm, ps in (("control", control), ("sham", sham), ("method", method)) for i, p in enumerate(ps)]

    rows = reps("unstable", [1, 0], [1, 1], [1, 1], True) + reps("noop", [1, 1], [1, 1], [0, 0], False) + reps("fragile", [1, 1], [1, 1], [0, 0], True) + reps("improved", [0, 0], [1, 1], [1, 1], True) + reps("same", [1, 1], [1, 1], [1, 1], True) + reps("missing", [1, 1], [], [1, 1], True) + reps("other", [1, 1], [1, 1], [1, 0], True)
    got = {r["task"]: r["task_class"] for r in audits.task_classes(spark.createDataFrame(rows, "task string, arm string, rep int, passed boolean, fired boolean")).collect()}
    assert got == {"unstable": "INHERENTLY_UNSTABLE", "noop": "NO_OP_FALSE_ATTRIBUTION", "fragile": "TRUE_PRUNING_FRAGILITY", "improved": "TRUE_PRUNING_IMPROVEMENT", "same": "STABLE_NO_EFFECT", "missing": "INCONCLUSIVE", "other": "INCONCLUSIVE"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k int, s string, x double")
    sinks.jsonl(df, f"{tmp_path}/j")
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["k"] for x in lines) == [1, 2] and all(set(x) == {"k", "s", "x"} for x in lines)
    sinks.parquet_and_csv(df, f"{tmp_path}/two")
    assert spark.read.parquet(f"{tmp_path}/two/parquet").count() == spark.read.option("header", "true").csv(f"{tmp_path}/two/csv").count() == 2
    assert [sinks.append_ledger(df, f"{tmp_path}/ledger", "k"), sinks.append_ledger(df, f"{tmp_path}/ledger", "k")] == [2, 0]
    assert sinks.append_ledger(df.withColumn("k", F.col("k") + 1), f"{tmp_path}/ledger", "k") == 1
    public, private = sinks.split_projection(df, "s", ("x",))
    assert public.columns == ["k", "locator"] and set(private.columns) == {"k", "s", "x", "locator"}


def test_empty_arms_and_zero_medians_give_null(spark):
    t = spark.createDataFrame([Row(unit=1, cluster="c", stratum="s", a=1, y=2.0)])
    assert statistics.newcombe(t, F.col("y") > 1, -0.1).first()["diff"] is None
    assert statistics.hajek(t, {"never": F.lit(0)}).first()["hajek"] is None
    assert statistics.spearman(t, "y", "a", "unit").first()["rho"] is None
    flat = spark.createDataFrame([(0.0,), (0.0,), (0.0,)], "y double")
    assert statistics.moments(flat).first()["max_over_median"] is None
    zero = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 0.0)], "method string, input_tokens double, cache_read_tokens double, cache_creation_tokens double, output_tokens double")
    assert ledger.decomposition(zero, (1.0, 0.1, 1.25, 5.0)).first()["input_share"] is None


def test_tasks_without_a_feasible_method_keep_the_baseline(spark):
    costs = spark.createDataFrame([("t1", "base", 10.0, False), ("t1", "m", 2.0, False), ("t2", "base", 10.0, False), ("t2", "m", 2.0, True)], "task_id string, method string, cost double, ok boolean")
    got = {r["task_id"]: (r["method"], r["cost"]) for r in studies.feasible_oracle(costs, F.col("ok"), 0.05, "base").collect()}
    assert got == {"t1": ("base", 10.0), "t2": ("m", 2.0)}


def test_recurrence_by_kind_against_python(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice("abcd"), rng.random() < 0.4) for k in range(3) for i in range(25)]
    got = {(r["k"], r["i"]): (r["in_plans"], r["in_outputs"]) for r in sequence.recurrence_by_kind(spark.createDataFrame(rows, "k int, i int, e string, p boolean"), "k", "i", "e", F.col("p")).collect()}
    for k, i, e, _ in rows:
        before = [(x, p) for kk, ii, x, p in rows if kk == k and ii < i]
        plans, outputs = [x for x, p in before if p][-2:], [x for x, p in before if not p][-3:]
        assert got[k, i] == (e in plans, e in outputs)
