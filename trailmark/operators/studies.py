"""Selectors, held-out policies, calibration, simulations, and name clustering."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranks
from .statistics import uniform

# --- fixed values -----------------------------------------------------------
#: Rates of stale searches and of churn from which a selector acts, by risk.
SELECTOR_THRESHOLDS = {"LOW": (0.7, 0.6), "MEDIUM": (0.5, 0.4), "HIGH": (0.35, 0.3)}
#: Two names are of one cluster from this similarity, or from the second with definitions from the third.
NAME_SIMILAR, NAME_NEAR, DEFINITION_NEAR = 0.45, 0.3, 0.5
# ----------------------------------------------------------------------------
USER_PATHS = ((r"/data/users/\w+", "/data/USER"), (r"/home/\w+", "/home/USER"))


def scrub(text: Column, rules: tuple[tuple[str, str], ...] = USER_PATHS) -> Column:
    """Ordered replacements that hide who made a text; ``rules`` are (pattern, text)."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def select_config(search: Column, churn: Column, untested: Column, risk: str = "MEDIUM") -> Column:
    """The configuration that a trace's prefix asks for; missing rates ask for none."""
    s, c = SELECTOR_THRESHOLDS[risk]
    return F.when(search >= s, "SEARCH_CONSTRAINED").when(churn >= c, "PATCH_GUARD").when(untested, "VERIFY_HEAVY").otherwise("DEFAULT")


def held_out_threshold(pairs: DataFrame, group: str, signal: str, grid: tuple[float, ...]) -> DataFrame:
    """For each group the threshold that was cheapest on all others, and its cost here.

    Costs at each threshold are conditional sums of a group; the others' are totals less
    its own, so nothing is joined or fitted again.
    """
    cost = lambda t: F.sum(F.when(F.col(signal) >= t, F.col("cost")).otherwise(F.col("base")))
    own = pairs.groupBy(group).agg(*(cost(t).alias(f"c{i}") for i, t in enumerate(grid)), F.sum("base").alias("keep"), F.sum("cost").alias("always"))
    total = own.agg(*(F.sum(f"c{i}").alias(f"t{i}") for i in range(len(grid))))
    options = F.array(*(F.struct((F.col(f"t{i}") - F.col(f"c{i}")).alias("rest"), F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("here")) for i, t in enumerate(grid)))
    best = own.join(F.broadcast(total)).withColumn("best", F.array_min(options))  # least cost on the rest, then least threshold
    return best.select(group, F.col("best.threshold").alias("threshold"), F.col("best.here").alias("policy"), "keep", "always")


def feasible_oracle(costs: DataFrame, solved: Column, tolerance: float, baseline: str) -> DataFrame:
    """Cheapest solved method of each task, if it saves more than the tolerance; tasks
    without a solved method keep the baseline."""
    best = costs.where(solved).groupBy("task_id").agg(F.min(F.struct("cost", "method")).alias("b"))
    base = costs.where(F.col("method") == baseline).select("task_id", F.col("cost").alias("base"))
    return base.join(best, "task_id", "left").select("task_id", "base", F.when(F.col("b.cost") < (1 - tolerance) * F.col("base"), F.col("b.method")).otherwise(baseline).alias("method"), F.least("base", F.when(F.col("b.cost") < (1 - tolerance) * F.col("base"), F.col("b.cost")).otherwise(F.col("base"))).alias("cost"))


def calibration(df: DataFrame, predicted: str, actual: str, tie: str, bins: int = 3) -> DataFrame:
    """Mean prediction and outcome of equally filled bins of the prediction."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"))
    placed = ranks.place(df.select(predicted, actual, F.col(tie).alias("_tie")), [predicted, "_tie"], "_at").join(F.broadcast(n))
    whole, more, k = F.floor(F.col("_rows") / bins), F.col("_rows") % bins, F.col("_at") - 1
    large = more * (whole + 1)  # rows of the first bins, which hold one more
    b = F.when(k < large, F.floor(k / (whole + 1))).otherwise(more + F.floor(F.try_divide(k - large, whole))) + 1
    return placed.select(b.alias("bin"), predicted, actual).groupBy("bin").agg(F.avg(predicted).alias("predicted"), F.avg(actual).alias("actual"), F.count(F.lit(1)).alias("n"))


def coverage_curve(df: DataFrame, score: str, gain: str, cuts: tuple[float, ...]) -> DataFrame:
    """Share of rows at or above each cut and their mean gain, in one pass."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(float(c)).alias("cut"), (F.count_if(F.col(score) >= c) / n).alias("coverage"), F.avg(F.when(F.col(score) >= c, F.col(gain))).alias("gain")) for c in cuts]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def out_of_fold_ridge(df: DataFrame, group: str, unit: str, y: str, x: list[str], penalty: float = 10.0) -> DataFrame:
    """Ridge predictions for each group from all others, features standardised there.

    A group is a Gram matrix; the others' is the total less its own.  Solving is a small
    system a group, in Arrow batches; rows only meet their group's coefficients.
    """
    cols, k = [F.lit(1.0), *(F.col(c).cast("double") for c in x), F.col(y).cast("double")], len(x)
    gram = [F.sum(a * b) for a in cols for b in cols]
    own = df.dropna(subset=[y, *x]).groupBy(group).agg(F.array(*gram).alias("_gram"))
    total = own.agg(F.array(*(F.sum(F.get("_gram", F.lit(i))) for i in range(len(gram)))).alias("_total"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for own_, all_ in zip(f["_gram"], f["_total"], strict=True):
                m = (np.asarray(all_) - np.asarray(own_)).reshape(k + 2, k + 2)
                n = m[0, 0]
                if n < k + 2:
                    out.append([m[0, -1] / n if n else 0.0, *[0.0] * k])
                    continue
                mean = m[0, 1:-1] / n
                sd = np.sqrt(np.maximum(np.diag(m)[1:-1] / n - mean**2, 0))
                sd[sd < 1e-12] = 1
                centred = (m[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
                beta = np.linalg.solve(centred + penalty * np.eye(k), (m[1:-1, -1] - mean * m[0, -1]) / sd) / sd
                out.append([m[0, -1] / n - beta @ mean, *beta])
            yield pd.DataFrame({group: f[group], "_beta": out})

    kind = f"{group} {df.schema[group].dataType.simpleString()}, _beta array<double>"
    beta = own.join(F.broadcast(total)).mapInPandas(solve, kind)
    value = sum((F.get("_beta", F.lit(i + 1)) * F.col(c) for i, c in enumerate(x)), F.get("_beta", F.lit(0)))
    return df.join(beta, group).select(unit, group, y, value.alias("predicted"))


def placebo(df: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Where the moderator's contrast stands among those of hash-drawn moderators."""
    high = F.when(F.col("draw") == 0, F.col("moderator") > 0.5).otherwise(uniform(F.lit(seed), F.col("draw"), F.col("unit")) > 0.5)
    drawn = df.select("unit", "a", "y", "moderator", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw")).withColumn("high", high)
    mean = lambda h, a: F.avg(F.when((F.col("high") == h) & (F.col("a") == a), F.col("y")))
    t = drawn.groupBy("draw").agg((mean(True, 1) - mean(True, 0) - mean(False, 1) + mean(False, 0)).alias("t"))
    seen = F.max(F.when(F.col("draw") == 0, F.col("t"))).over(Window.partitionBy())
    return t.withColumn("seen", seen).where("draw > 0").agg(F.max("seen").alias("observed"), F.avg((F.col("t") >= F.col("seen")).cast("double")).alias("upper_tail"), F.count(F.lit(1)).alias("draws"))


def simulate(spark: SparkSession, draws: int, model, kind: str, tasks: int = 8) -> DataFrame:
    """Monte Carlo in parallel: ``model(draw) -> dict`` on each of ``draws`` numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([model(int(i)) for i in f["id"]])

    return spark.range(0, draws, 1, tasks).mapInPandas(run, kind)


def null_gap(spark: SparkSession, costs: np.ndarray, sigma: float, actions: int = 4, rho: float = 0.0, draws: int = 200, seed: int = 0) -> DataFrame:
    """The oracle's gap that noise alone makes when all actions cost the same."""

    def model(i: int) -> dict:
        rng = np.random.default_rng((seed, i))
        z = np.sqrt(rho) * rng.normal(0, sigma, (len(costs), 1)) + np.sqrt(1 - rho) * rng.normal(0, sigma, (len(costs), actions))
        c = costs[:, None] * np.exp(z)
        return {"gap": 100 * (c[:, 0].mean() - c.min(1).mean()) / c[:, 0].mean()}

    g = simulate(spark, draws, model, "gap double")
    return g.agg(F.avg("gap").alias("gap"), F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws"))


def power(spark: SparkSession, units: int, effect: float, sd: float, draws: int = 200, seed: int = 0) -> DataFrame:
    """Share of simulated balanced trials whose difference in means is beyond 1.96 errors."""

    def model(i: int) -> dict:
        rng = np.random.default_rng((seed, i))
        a = np.repeat([0, 1], units // 2)
        y = effect * a + rng.normal(0, sd, len(a))
        one, zero = y[a == 1], y[a == 0]
        t = (one.mean() - zero.mean()) / np.sqrt(one.var(ddof=1) / len(one) + zero.var(ddof=1) / len(zero))
        return {"hit": bool(abs(t) > 1.96)}

    return simulate(spark, draws, model, "hit boolean").agg(F.avg(F.col("hit").cast("double")).alias("power"), F.count(F.lit(1)).alias("draws"))


def name_similarity(a: str, b: str) -> float:
    """The greater of token overlap and matching blocks."""
    ta, tb = (set(re.split(r"[_\s]+", x.lower())) for x in (a, b))
    letters = [re.sub(r"[^a-z]", "", x.lower()) for x in (a, b)]
    return max(len(ta & tb) / max(len(ta | tb), 1), difflib.SequenceMatcher(None, *letters).ratio())


def cluster_names(proposals: DataFrame, family: str = "family") -> DataFrame:
    """Greedy first-fit clusters of (family, name, definition, coder) in order of position,
    against each cluster's first member; with the coders that support a cluster."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        firsts: list[tuple[str, str]] = []
        of = []
        f = f.sort_values("position")
        for name, definition in zip(f["name"].fillna(""), f["definition"].fillna(""), strict=True):
            for i, (first, text) in enumerate(firsts):
                s = name_similarity(name, first)
                if s >= NAME_SIMILAR or (s >= NAME_NEAR and difflib.SequenceMatcher(None, definition[:300].lower(), text[:300].lower()).ratio() >= DEFINITION_NEAR):
                    of.append(i)
                    break
            else:
                of.append(len(firsts))
                firsts.append((name, definition))
        return f.assign(cluster=of)[[family, "position", "name", "coder", "cluster"]]

    return proposals.groupBy(family).applyInPandas(run, f"{family} string, position long, name string, coder string, cluster long")


def shards(df: DataFrame, order: str, size: int = 12) -> DataFrame:
    """The shard of each row, ``size`` rows to a shard in the order given."""
    return ranks.place(df, [order], "shard").withColumn("shard", F.floor((F.col("shard") - 1) / size))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become medians, beside a flag that says so."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_value")) for c in columns))).alias("_r")).select("_r.*")
    medians = ranks.quantiles(long, ["_c"], "_value", _m=0.5).agg(*(F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"_m_{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}
    return df.join(F.broadcast(medians)).withColumns({f"miss_{c}": F.col(c).isNull() for c in columns}).withColumns(filled).drop(*(f"_m_{c}" for c in columns))
