"""Distributed places and quantiles against sorting and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import ledger, ranks, statistics, studies


def rows(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    data = [(i, f"g{rng.integers(3)}" if rng.random() > 0.1 else None, None if rng.random() < 0.1 else float(rng.integers(20)) if rng.random() < 0.5 else float(rng.normal())) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, g string, v double")


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_place_is_the_sorted_order(spark, n):
    data, df = rows(spark, n)
    want = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
    got = sorted(ranks.place(df, ["v", "id"], "at").collect(), key=lambda r: r["at"])
    assert [(r["id"], r["at"]) for r in got] == [(w[0], i + 1) for i, w in enumerate(want)]


@pytest.mark.parametrize("n", [0, 1, 5, 1500])
def test_quantiles_equal_numpy(spark, n):
    data, df = rows(spark, n, 1)
    got = {r["g"]: (r["low"], r["mid"]) for r in ranks.quantiles(df, ["g"], "v", low=0.1, mid=0.5).collect()}
    want = {}
    for g in {r[1] for r in data if r[2] is not None}:
        v = [r[2] for r in data if r[1] == g and r[2] is not None]
        want[g] = (np.quantile(v, 0.1), np.quantile(v, 0.5))
    assert got.keys() == want.keys()
    for g, w in want.items():
        assert got[g] == pytest.approx(w)


def test_a_value_held_by_most_rows_is_one_row(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    assert ranks.sorted_counts(df, ["g"], "v").count() == 1668
    v = [float(i) if i % 3 == 0 else 7.0 for i in range(5000)]
    assert ranks.quantiles(df, [], "v", q=0.9).first()["q"] == pytest.approx(np.quantile(v, 0.9))


def test_bins_are_those_of_an_equal_split(spark):
    df = spark.range(11).select("id", (F.col("id") * 7 % 11).cast("double").alias("p"), F.col("id").cast("double").alias("y"))
    got = {r["bin"]: (r["n"], round(r["predicted"], 6)) for r in studies.calibration(df, "p", "y", "id", 4).collect()}
    assert got == {i + 1: (len(b), round(float(np.mean(b)), 6)) for i, b in enumerate(np.array_split(np.arange(11.0), 4))}


def test_clashing_column_names_pass_through(spark):
    df = spark.createDataFrame([(2, 5), (1, 6)], "v long, at long")
    got = ranks.place(df, ["v"], "n").orderBy("v").collect()
    assert [(r["v"], r["at"], r["n"]) for r in got] == [(1, 6, 1), (2, 5, 2)]


def test_empty_tables_give_no_quantiles(spark):
    empty = spark.createDataFrame([], "grp long, v double, y double, a int, stratum string, unit long, moderator double")
    assert ledger.quantile_cap(empty, "grp", "v", 0.75).count() == 0
    assert ledger.exclusive_tertiles(empty, "grp", "v").count() == 0
    assert statistics.auroc(empty, "y", F.col("a") == 1).first()["auroc"] is None
    assert statistics.spearman(empty, "y", "moderator", "unit").first()["rho"] is None


def test_any_statistic_can_be_resampled(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    got = statistics.bootstrap(df, "c", {"s": F.sum("v"), "n": F.count("v")}, F.try_divide("s", "n"), 200).first()
    assert got["low"] < 2.99 < got["high"] and got["draws"] == 200
