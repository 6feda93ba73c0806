"""Designs, metrics, verdicts and merging against plain Python."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trailmark.operators import experiments, sequence

UNITS = "block long, position long, unit long, a int, y double, m double"


def units(n=37, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        block, position = i // 4, i % 4
        a = int(position in experiments.PATTERNS[block % 6])
        m = float(rng.random())
        out.append((block, position, i, a, float(5 + block + 2 * a - 3 * a * m + rng.normal()), m))
    return out


def fit(rows):
    """The interaction's coefficient and ratio to its classical error, by a full design matrix."""
    blocks = sorted({r[0] for r in rows})
    x = np.array([[float(r[0] == b) for b in blocks] + [r[3], r[5], r[3] * r[5]] for r in rows])
    y = np.array([r[4] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    se = np.sqrt(np.linalg.inv(x.T @ x)[-1, -1] * (rest @ rest) / (len(y) - x.shape[1]))
    return beta[-1], beta[-1] / se


def test_interaction_beside_block_effects_equals_least_squares(spark):
    data = units(36)
    got = experiments.interaction_null(spark.createDataFrame(data, UNITS), "m", 40).first()
    b, t = fit(data)
    assert (got["b"], got["t"]) == (pytest.approx(b), pytest.approx(t))
    assert 0 < got["p_sharp"] <= 1 and got["draws"] == 40


def test_incomplete_blocks_keep_six_patterns(spark):
    df = spark.createDataFrame(units(37), UNITS)
    assert experiments.assignment_space(df).count() == 37 * 6
    assert {r["propensity"] for r in experiments.design_propensity(df).collect()} == {0.5}
    assert all(r["in_space"] for r in experiments.design_check(df).collect())
    wrong = spark.createDataFrame([(0, p, p, int(p < 3), 1.0, 0.5) for p in range(4)], UNITS)
    assert not experiments.design_check(wrong).first()["in_space"]


def test_empty_and_null_units(spark):
    empty = spark.createDataFrame([], UNITS)
    assert experiments.design_check(empty).count() == 0
    assert experiments.interaction_null(empty, "m", 5).first()["b"] is None
    nulls = spark.createDataFrame([(None, 0, 1, None, None, None), (0, 0, 1, 1, 2.0, 0.1)], UNITS)
    assert experiments.interaction_null(nulls, "m", 5).first()["b"] is None


def test_class_metrics_equal_plain_python(spark):
    rng = np.random.default_rng(1)
    data = [(float(rng.integers(10)) / 10, bool(rng.random() < 0.4)) for _ in range(200)]
    got = experiments.class_metrics(spark.createDataFrame(data, "s double, y boolean"), "s", F.col("y")).first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    assert got["auroc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    ap = 0.0
    for cut in sorted({s for s, _ in data}):
        above = [y for s, y in data if s >= cut]
        ap += sum(y for s, y in data if s == cut) / len(pos) * sum(above) / len(above)
    assert got["auprc"] == pytest.approx(ap)
    assert got["brier"] == pytest.approx(np.mean([(s - y) ** 2 for s, y in data]))
    clip = lambda s: min(max(s, 1e-15), 1 - 1e-15)
    assert got["log_loss"] == pytest.approx(-np.mean([np.log(clip(s)) if y else np.log(1 - clip(s)) for s, y in data]))
    none = experiments.class_metrics(spark.createDataFrame([], "s double, y boolean"), "s", F.col("y")).first()
    assert none["auroc"] is None and none["n"] == 0


def test_dose_and_kind_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    data = [(float(d), bool(k), float(1 + 0.2 * d + 0.5 * k + rng.normal())) for d, k in zip(rng.random(80) * 9, rng.random(80) < 0.5, strict=True)]
    got = experiments.dose_controlled(spark.createDataFrame(data, "d double, k boolean, y double"), "d", F.col("k"), "y").first()
    beta, *_ = np.linalg.lstsq(np.array([[1, d, k] for d, k, _ in data], float), np.array([y for *_, y in data]), rcond=None)
    assert (got["dose"], got["kind"]) == (pytest.approx(beta[1]), pytest.approx(beta[2]))
    same = spark.createDataFrame([(1.0, True, 2.0)] * 3, "d double, k boolean, y double")
    assert experiments.dose_controlled(same, "d", F.col("k"), "y").first()["kind"] is None


GOOD = dict(prefix_ok=True, noop_ok=True, in_space=True, infra=0, ate_low=-9.0, ate_high=-1.0, b3_low=-5.0, b3_high=-1.0, p_sharp=0.01, rework_n=4, creation_diff=-2.0, risk_low=-0.02, margin=-0.1, signal=1.0, keep=3.0, always=2.0)


@pytest.mark.parametrize(
    ("change", "claim", "verdict"),
    [
        ({}, "PROTOCOL_INTEGRITY", "SUPPORTED"), ({"infra": 1}, "PROTOCOL_INTEGRITY", "NOT_SUPPORTED"), ({"in_space": None}, "PROTOCOL_INTEGRITY", "NOT_SUPPORTED"),
        ({}, "AVERAGE_EFFECT", "ESTABLISHED"), ({"ate_high": 1.0}, "AVERAGE_EFFECT", "DIRECTIONAL"), ({"ate_high": 19.0}, "AVERAGE_EFFECT", "NOT_ESTABLISHED"), ({"ate_low": None, "ate_high": None}, "AVERAGE_EFFECT", "NOT_ESTABLISHED"),
        ({}, "MODERATOR", "ESTABLISHED"), ({"p_sharp": 0.2}, "MODERATOR", "NOT_ESTABLISHED"), ({"rework_n": 0}, "REWORK_SAFETY", "NOT_ESTIMABLE"),
        ({"risk_low": -0.2}, "NON_INFERIORITY", "NOT_MET"), ({"signal": 2.5}, "SIGNAL_POLICY", "NOT_SUPPORTED"), ({}, "DEPLOYABLE", "SUPPORTED"), ({"always": None}, "DEPLOYABLE", "NOT_SUPPORTED"),
    ],
)
def test_verdicts(spark, change, claim, verdict):
    kind = "prefix_ok boolean, noop_ok boolean, in_space boolean, infra int, ate_low double, ate_high double, b3_low double, b3_high double, p_sharp double, rework_n int, creation_diff double, risk_low double, margin double, signal double, keep double, always double"
    got = {r["claim"]: r["verdict"] for r in experiments.verdicts(spark.createDataFrame([Row(**{**GOOD, **change})], kind)).collect()}
    assert len(got) == 9 and got[claim] == verdict


def test_merge_takes_only_evidenced_labels_and_the_first_of_ties(spark):
    kind = "unit long, rater string, primary string, labels array<struct<label:string,evidence:array<int>>>"
    df = spark.createDataFrame([(1, "r2", "B", [("x", [3, 1]), ("y", [])]), (1, "r1", "A", [("x", [2, 3])]), (2, "r1", None, None)], kind)
    got = {r["unit"]: r for r in experiments.merge_evidenced(df).collect()}
    assert got[1]["primary"] == "A" and [(x["label"], x["support"], x["evidence"]) for x in got[1]["labels"]] == [("x", 2, [1, 2, 3])]
    assert got[2]["primary"] is None and got[2]["labels"] == []


def test_precision_looks_at_the_strongest_traces(spark):
    df = spark.createDataFrame([("f", i, float(100 - i), int(i % 2), int(i % 4 == 1)) for i in range(100)], "feature string, trace_id long, signal double, flagged int, confirmed int")
    got = experiments.detector_precision(df).first()
    assert (got["traces"], got["flagged"], got["confirmed"]) == (25, 25, 13)


def test_missing_features_are_no_sign_of_waste(spark):
    columns = ("duplicate_file_reads", "unique_files_searched", "exact_duplicate_call_rate", "patch_attempts", "first_edit_step", "search_call_count", "longest_tool_error_run", "targeted_test_count", "unchanged_repeated_tests", "longest_no_new_evidence_streak", "environment_setup_events")
    df = spark.createDataFrame([("a", None)], "solver string, termination_reason string").select("*", *(F.lit(None).cast("double").alias(c) for c in columns))
    got = {r["kind"]: r["prevalence"] for r in experiments.opportunity(df, "solver", ("a",), ("b",)).collect()}
    assert {k for k, v in got.items() if v} == {"VERIFICATION_GAP"} and len(got) == 16


def test_stagnation_counts_rows_without_a_new_result_or_file(spark):
    df = spark.createDataFrame([("t", 0, "h", ["f"]), ("t", 1, "h", ["f"]), ("t", 2, "h", []), ("t", 3, "h", ["g"]), ("t", 4, "h", None), ("t", 5, "k", None)], "k string, i long, r string, fs array<string>")
    got = sequence.stagnation(df, "k", "i", "r", "fs").first()
    assert (got["longest"], got["fraction"]) == (2, pytest.approx(0.5))
