"""Operators on groups that hold most rows, against plain Python; no window meets them whole."""

import hashlib
import random

import pytest

from trailmark.operators import audits, statistics


def at_windows(df):
    """Rows that reach each window of the plan that ran."""

    def children(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return [node.executedPlan()]
        if name.endswith("QueryStageExec"):
            return [node.plan()]
        if name == "ReusedExchangeExec":
            return [node.child()]
        return [node.children().apply(i) for i in range(node.children().size())]

    def rows(node):
        for metric in ("shuffleRecordsWritten", "numOutputRows"):
            if node.metrics().contains(metric) and node.metrics().apply(metric).value() > 0:
                return node.metrics().apply(metric).value()
        return max((rows(c) for c in children(node)), default=0)

    def walk(node):
        own = [rows(children(node)[0])] if node.getClass().getSimpleName() == "WindowExec" else []
        return own + [n for c in children(node) for n in walk(c)]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def permuted(data, draws):
    """p and effect by sorting each block of each draw."""

    def effect(arms):
        total = n = 0
        for b in {r[1] for r in data}:
            cell = [(arms[r[0]], r[3]) for r in data if r[1] == b]
            mean = [[y for a, y in cell if a == k and y is not None] for k in (0, 1)]
            if mean[0] and mean[1]:
                total += (sum(mean[1]) / len(mean[1]) - sum(mean[0]) / len(mean[0])) * len(cell)
                n += len(cell)
        return total / n

    seen, hits = effect({r[0]: r[2] for r in data}), 0
    for draw in range(1, draws + 1):
        arms = {}
        for b in {r[1] for r in data}:
            units = sorted((int(hashlib.sha256(f"0|{draw}|{r[0]}".encode()).hexdigest()[:8], 16), r[0]) for r in data if r[1] == b)
            k = [r[2] for r in data if r[1] == b and r[2] is not None]
            arms |= {u: int(i < sum(k)) if k else None for i, (_, u) in enumerate(units)}
        hits += abs(effect(arms)) >= abs(seen) - 1e-12
    return (hits + 1) / (draws + 1), seen


def test_block_permutation_equals_sorting_each_block(spark):
    rng = random.Random(1)
    block = lambda i: "big" if i < 300 else None if i < 340 else "one arm" if i < 350 else "no arm" if i < 353 else f"b{i // 4}"
    arm = lambda b: 1 if b == "one arm" else None if b == "no arm" or rng.random() < 0.05 else int(rng.random() < 0.3)
    data = [(i, block(i), arm(block(i)), None if rng.random() < 0.1 else float(rng.randrange(100))) for i in range(400)]
    got = statistics.block_permutation(spark.createDataFrame(data, "unit long, block string, a int, y double"), "block", 30).first()
    p, seen = permuted(data, 30)
    assert (got["p"], got["ate"], got["draws"]) == (pytest.approx(p), pytest.approx(seen), 30)


def test_a_large_block_is_not_put_in_order(spark):
    df = spark.range(20_000).selectExpr("id AS unit", "'b' AS block", "cast(id % 3 = 0 AS int) AS a", "cast(id AS double) AS y")
    found = at_windows(statistics.block_permutation(df, "block", 20))
    assert found and max(found) < 20_000


def sampled(data, quota, size):
    """(unit, cell, axis, taken) by three passes over the sorted rows."""
    left = sorted(data, key=lambda r: (hashlib.sha256(str(r[0]).encode()).hexdigest(), r[0]))
    out, cells, axes = [], set(), {}
    for r in left:
        if r[1] not in cells:
            cells.add(r[1])
            out.append((*r, 1))
    for r in out:
        left.remove(r[:3])
    for r in left:
        axes[r[2]] = axes.get(r[2], 0) + 1
        out.append((*r, 2 if axes[r[2]] <= quota else 3))
    return sorted(out, key=lambda r: (r[3], hashlib.sha256(str(r[0]).encode()).hexdigest(), r[0]))[:size]


@pytest.mark.parametrize("quota, size, cells", [(3, 20, 4), (0, 7, 30), (5, 12, 3), (50, 400, 5), (2, 0, 3)])
def test_audit_sample_equals_three_passes(spark, quota, size, cells):
    rng = random.Random(2)
    data = [(i, f"c{rng.randrange(cells)}" if i % 9 else None, f"a{rng.randrange(3)}" if i % 7 else None) for i in range(200)]
    data += [r for r in data[:60] for _ in range(3)]  # equal rows count each
    got = audits.audit_sample(spark.createDataFrame(data, "u long, c string, x string"), "u", "c", "x", quota, size).collect()
    assert [tuple(r) for r in got] == sampled(data, quota, size)


def test_a_large_cell_is_cut_before_its_rows_meet(spark):
    df = spark.range(20_000).selectExpr("id AS u", "'c' AS c", "cast(id % 2 AS string) AS x")
    found = at_windows(audits.audit_sample(df, "u", "c", "x", 5, 30))
    assert found and max(found) < 2_000
