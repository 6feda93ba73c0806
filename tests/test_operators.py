"""Golden pairs, firewall properties, transforms by hand, and the streaming job."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trailmark.functions import columns as C
from trailmark.operators import ledger, messages, sequence, statistics, studies
from trailmark.streaming import trial

GOLDEN = [
    ("find /testbed -name '*.py'", None, "SEARCH"), ("grep -r foo /x", None, "SEARCH"), ("cat <<EOF > /testbed/edit_file.py", None, "EDIT"),
    ("cat <<EOF > /testbed/test_x.py", None, "EDIT"), ("create reproduce.py", None, "EDIT"), ("edit 1:5", None, "EDIT"), ("open astropy/x.py", None, "READ"),
    ("python setup.py build_ext --inplace", None, "ENVIRONMENT"), ("pip install cython", None, "ENVIRONMENT"), ("python -m pytest tests/", None, "TEST"),
    ("python reproduce.py", None, "EXECUTE"), ("submit", None, "FINISH"), ("git apply p.diff", None, "PATCH_APPLY"), ("cat foo.py", None, "READ"),
    ("python /x/edit_file.py view 1 50", None, "EXECUTE"), (None, "let me think", "PLAN"), (None, None, "OTHER"), ("", "", "OTHER"),
]


def test_command_types(spark):
    df = spark.createDataFrame([(c, t) for c, t, _ in GOLDEN], "c string, t string")
    assert [r[0] for r in df.select(C.classify_command(F.col("c"), F.col("t"))).collect()] == [g[2] for g in GOLDEN]


CLEAN = [
    ("pytest > out.txt", None, "TEST"), ("cat > a.py", None, "EDIT"), ("find . -name x", None, "SEARCH"), ("pre-find x", None, "EXEC_OTHER"), ("ls -la", None, "READ"),
    ("git status", None, "EXEC_OTHER"), ("", None, "OTHER"), ("str_replace_editor view a.py", None, "READ"), ("str_replace_editor create a.py", None, "EDIT"),
    ("x", "finish", "SUBMIT"), ("view a", "file_editor", "READ"), ("create a", "file_editor", "EDIT"), ("pip install x", "execute_bash", "ENV"), ("goto 5", None, "READ"),
]


def test_clean_classes(spark):
    df = spark.createDataFrame([(a, t) for a, t, _ in CLEAN], "a string, t string")
    assert [r[0]["cls"] for r in df.select(C.classify_clean(F.col("a"), F.col("t"))).collect()] == [g[2] for g in CLEAN]


def test_observations(spark):
    obs = ["Traceback (most recent call last):\nX", "bash: no such file", "12 passed", "1 failed, 2 passed", "ok", "<returncode>1</returncode>", "fine error: text", None, "  ", "\nValueError: x", "E   assert"]
    rows = spark.createDataFrame([(o,) for o in obs], "o string").select(C.error_marker(F.col("o")).alias("m"), C.test_result(F.col("o")).alias("t"), C.is_error(F.col("o")).alias("e"), C.is_empty_result(F.col("o")).alias("n"), C.is_oversized(F.col("o"), 20).alias("b"))
    got = rows.collect()
    assert [r["m"] for r in got][:2] == ["traceback (most recent call last)", "no such file"] and got[6]["m"] == "error" and got[7]["m"] is None
    assert [r["t"] for r in got][2:5] == ["PASS", "MIXED", "PASS"] and got[7]["t"] is None
    assert [r["e"] for r in got] == [True, True, False, False, False, True, False, False, False, True, True]
    assert got[7]["n"] and got[8]["n"] and got[1]["n"] and not got[7]["b"] and got[0]["b"]


def test_cost_and_bounds(spark):
    row = spark.range(1).select(C.effective_cost(F.lit(100), F.lit(1000), F.lit(50), F.lit(20)).alias("c"), C.effective_cost(F.lit(None), F.lit(None), F.lit(4), F.lit(None)).alias("n"), C.wilson_upper(F.lit(0), F.lit(0)).alias("w"), C.wilson_upper(F.lit(4), F.lit(160)).alias("u")).first()
    assert row["c"] == pytest.approx(362.5) and row["n"] == 5.0 and row["w"] == 1.0 and row["u"] == pytest.approx(0.0547, abs=1e-3)


def test_prefix_is_bounded_true_and_monotone(spark):
    df = spark.createDataFrame([(t, i, "PLAN" if i % 3 == 0 else "TEST", i * 1.0) for t in (1, 2) for i in range(30)], "t int, i int, k string, tokens double")
    last = set()
    for k in (0, 1, 5, 20, 1000):
        rows = sequence.meaningful_prefix(df, "t", "i", k, F.col("k") != "PLAN").collect()
        assert all(sum(r["k"] != "PLAN" for r in rows if r["t"] == t) == min(k, 20) for t in (1, 2))
        now = {(r["t"], r["i"]) for r in rows}
        assert last <= now and all({i for t, i in now if t == 1} == set(range(max((i for t, i in now if t == 1), default=-1) + 1)) for _ in (0,))
        last = now
    view = sequence.firewall(df, ("tokens",), ("k",))
    assert view.columns == ["t", "i", "tokens"] and view.where("tokens is not null").count() == 0


def test_horizon_truncates(spark):
    df = spark.createDataFrame([("a", 1, False, 9.0), ("a", 2, True, 100.0), ("a", 3, False, 50.0), ("a", 4, False, 30.0), ("a", 5, False, 7.0), ("b", 1, True, 100.0), ("b", 2, False, 50.0), ("c", 1, False, 5.0)], "t string, i int, s boolean, c double")
    got = {r["t"]: (r["total"], r["truncated"]) for r in sequence.horizon(df, "t", "i", F.col("s"), "c").collect()}
    assert got == {"a": (180.0, False), "b": (150.0, True)}


def test_pairing_with_missing_baseline(spark):
    df = spark.createDataFrame([(1, "N", 10.0), (1, "A", 5.0), (2, "A", 5.0), (3, "N", 0.0), (3, "A", 1.0)], "task_id int, method string, cost double")
    assert [tuple(r) for r in ledger.paired(df, "N").collect()] == [(1, "A", 10.0, 5.0, 50.0)]


OBS = "\n".join(f"line number {i} of the long output" for i in range(60))
CHAT = ["task", "plan", OBS, "cat a.py", OBS, "grep x", OBS + "\nnew tail line here", "pip install x", "log " * 200, "x" * 5000, "  a  \n\n\n\nb" * 30]


@pytest.fixture(scope="module")
def chat(spark):
    return spark.createDataFrame([(1, i, "user", t, i > 1) for i, t in enumerate(CHAT)], "req_id int, idx int, role string, text string, is_obs boolean")


def run(df, name):
    return [r["text"] for r in messages.apply_method(df, name).orderBy("idx").collect()]


def test_every_transform_keeps_rows_and_prefix(chat):
    assert len(messages.METHODS) == 41
    for name in messages.METHODS:
        out = messages.apply_method(chat, name)
        assert out.columns[:1] and set(out.columns) == set(chat.columns), name
        texts = run(chat, name)
        assert len(texts) == len(CHAT) and texts[:2] == CHAT[:2], name
    assert run(chat, "no such method") == CHAT


def test_transforms_by_hand(chat):
    got = run(chat, "M1_dedup_exact")
    assert got[4] == "[identical to the observation at step 2]" and got[2] == OBS
    n = len(CHAT[9])
    assert run(chat, "CAP2K_stable")[9] == "x" * 1200 + f"\n...[{n - 2000} chars elided]...\n" + "x" * 800
    assert run(chat, "M6_env_log_collapse")[8] == f"[build/env step succeeded; {len(CHAT[8])} chars of log elided]"
    lines = CHAT[6].split("\n")
    assert run(chat, "M5_search_head")[6] == "\n".join(lines[:20]) + f"\n…[{len(lines) - 20} more result lines elided]"
    assert run(chat, "LINEDEDUP_e4")[6] == "new tail line here\n[60 duplicate lines elided]"
    assert run(chat, "HALF_context")[9] == "x" * 2500
    assert run(chat, "DEDUP2_similar_obs")[6] == f"[~identical to observation at step 2; {len(CHAT[6])} chars]"
    kept = []
    run_drop = 0
    import re

    for line in OBS.split("\n"):
        if re.search(messages.SIGNAL, line) or (not line.strip() and run_drop == 0):
            kept.append(line)
            run_drop = 0
        else:
            run_drop += 1
            if run_drop == 1:
                kept.append("  ...")
    want = "\n".join(kept)
    assert run(chat, "SIGNAL_e4")[2] == (want if len(OBS) > 2000 and len(want) < 0.85 * len(OBS) else OBS)
    assert run(chat, "CNEG_recency")[3] == "[earlier turn dropped by recency window]"


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    c = rng.integers(0, 12, 200)
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([Row(x=float(a), z=float(b), y=float(v), c=int(k)) for (a, b), v, k in zip(x, y, c, strict=True)])
    got = {r["term"]: r for r in statistics.ols(df, "y", ["x", "z"], "c").collect()}
    m = np.column_stack([np.ones(200), x])
    beta, inv = np.linalg.lstsq(m, y, rcond=None)[0], np.linalg.inv(m.T @ m)
    e = y - m @ beta
    hc0 = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv))
    hc3 = np.sqrt(np.diag(inv @ (m.T * (e / (1 - np.einsum("ij,jk,ik->i", m, inv, m))) ** 2) @ m @ inv))
    s = np.stack([(m[c == k] * e[c == k, None]).sum(0) for k in np.unique(c)])
    g = len(np.unique(c))
    cluster = np.sqrt(np.diag(inv @ s.T @ s @ inv * g / (g - 1) * 199 / 197))
    for i, t in enumerate(("intercept", "x", "z")):
        assert (got[t]["coef"], got[t]["se_hc0"], got[t]["se_cluster"]) == pytest.approx((beta[i], hc0[i], cluster[i]))
        assert got[t]["se_hc3"] == pytest.approx(hc3[i])


def test_blocks_are_balanced_and_fixed():
    for b in range(50):
        arms = trial.permuted_block(7, "HIGH", b)
        assert sorted(arms) == sorted(trial.ARMS) and arms == trial.permuted_block(7, "HIGH", b)
    assert len({tuple(trial.permuted_block(7, "HIGH", b)) for b in range(200)}) == 6


def test_stream_restarts_and_equals_its_batch_twin(spark, tmp_path):
    kind = "task_id string, request_hash string, stratum string, available boolean, ts long"
    rows = [(f"t{i % 9}", f"h{i}", ("HIGH", "MIXED")[i % 9 % 2], i % 4 != 0, i) for i in range(60)]
    plan = trial.plan(spark, 11, ["HIGH", "MIXED"], 10)

    def step(part):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = trial.run_trial(source, plan, f"{tmp_path}/out", f"{tmp_path}/check")
        q.processAllAvailable()
        q.stop()

    step(rows[:25])
    step(rows[25:40])  # a new query on the same checkpoint
    step(rows[40:])
    events = spark.read.parquet(f"{tmp_path}/out/events")
    want, _ = trial.batch_twin(spark.createDataFrame(rows, kind), plan)
    key = lambda r: (r["task_id"], r["ordinal"], r["event_id"], r["intervene"])
    assert sorted(map(key, events.collect())) == sorted(map(key, want.collect()))
    got = spark.read.parquet(f"{tmp_path}/out/assigned").collect()
    assert len({r["task_id"] for r in got}) == len(got) == 9
    for s in ("HIGH", "MIXED"):
        assert sorted(r["slot"] for r in got if r["stratum"] == s) == list(range(sum(r["stratum"] == s for r in got)))
    arms = {(r["stratum"], r["slot"]): r["assignment"] for r in plan.collect()}
    assert all(arms[r["stratum"], r["slot"]] == r["assignment"] for r in got)


def test_ridge_leaves_each_group_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2)) * [1, 5] + 3
    g = rng.integers(0, 5, 120)
    y = x @ [1.0, 0.5] + rng.normal(size=120)
    df = spark.createDataFrame([Row(u=i, g=int(k), y=float(v), a=float(p), b=float(q)) for i, (k, v, (p, q)) in enumerate(zip(g, y, x, strict=True))])
    got = {r["u"]: r["predicted"] for r in studies.out_of_fold_ridge(df, "g", "u", "y", ["a", "b"]).collect()}
    for k in range(5):
        tr, te = x[g != k], x[g == k]
        mu, sd = tr.mean(0), tr.std(0)
        z = (tr - mu) / sd
        beta = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y[g != k] - y[g != k].mean()))
        want = y[g != k].mean() + (te - mu) / sd @ beta
        assert [got[i] for i in np.flatnonzero(g == k)] == pytest.approx(list(want))


def test_names_cluster_by_first_member(spark):
    rows = [("f", i, n, d, c) for i, (n, d, c) in enumerate([("repeat_file_read", "reads again", "x"), ("file_read_repeat", "", "y"), ("patch_churn", "edits", "x"), ("churn_of_patch", "edits", "z"), (None, None, "x")])]
    got = [r["cluster"] for r in studies.cluster_names(spark.createDataFrame(rows, "family string, position long, name string, definition string, coder string")).orderBy("position").collect()]
    assert got == [0, 0, 1, 1, 2]


def test_scrub_and_selector(spark):
    df = spark.createDataFrame([("/home/me/x /data/users/you/y", 0.6, None, False), ("", None, 0.45, True), ("", None, 0.1, True), ("", None, None, False)], "t string, s double, c double, u boolean")
    rows = df.select(studies.scrub(F.col("t")).alias("t"), studies.select_config(F.col("s"), F.col("c"), F.col("u")).alias("k")).collect()
    assert rows[0]["t"] == "/home/USER/x /data/USER/y"
    assert [r["k"] for r in rows] == ["SEARCH_CONSTRAINED", "PATCH_GUARD", "VERIFY_HEAVY", "DEFAULT"]
