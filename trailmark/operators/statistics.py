"""Estimators over trial rows (unit, cluster, stratum, a, y, ...).

Closed forms are aggregates.  Resampling draws come from hashes of (replicate,
cluster), so they are the same in every run and need no collected data; regressions
add up Gram matrices (a few numbers each) and solve them with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Z_TWO_SIDED, wilson
from . import ranks

#: Slots of the hashes of a permutation; a power of two.  A task holds one sum for each draw, block and slot.
SLOTS = 256


def difference_in_means(df: DataFrame, *by: str) -> DataFrame:
    one, zero = F.when(F.col("a") == 1, F.col("y")), F.when(F.col("a") == 0, F.col("y"))
    return df.groupBy(*by).agg(F.avg(one).alias("mean_1"), F.avg(zero).alias("mean_0"), (F.avg(one) - F.avg(zero)).alias("diff"), F.count(one).alias("n_1"), F.count(zero).alias("n_0"))


def block_adjusted(df: DataFrame, block: str) -> DataFrame:
    """Differences within blocks, weighted by size; blocks of one arm don't count."""
    d = difference_in_means(df, block).where("n_1 > 0 and n_0 > 0")
    n = F.col("n_1") + F.col("n_0")
    return d.agg((F.sum(F.col("diff") * n) / F.sum(n)).alias("ate"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("blocks"))


def newcombe(df: DataFrame, success: Column, margin: float) -> DataFrame:
    """Newcombe interval of the difference in success shares, and non-inferiority."""
    c = df.agg(F.count_if(success & (F.col("a") == 1)).alias("k1"), F.count_if(F.col("a") == 1).alias("n1"), F.count_if(success & (F.col("a") == 0)).alias("k0"), F.count_if(F.col("a") == 0).alias("n0"))
    k1, n1, k0, n0 = (F.col(x) for x in ("k1", "n1", "k0", "n0"))
    p1, p0 = F.try_divide(k1, n1), F.try_divide(k0, n0)  # null without an arm
    l1, u1, l0, u0 = (wilson(k, n, Z_TWO_SIDED, up) for k, n in ((k1, n1), (k0, n0)) for up in (False, True))
    d = p1 - p0
    low = d - F.sqrt((p1 - l1) ** 2 + (u0 - p0) ** 2)
    high = d + F.sqrt((u1 - p1) ** 2 + (p0 - l0) ** 2)
    return c.select(d.alias("diff"), low.alias("low"), high.alias("high"), (low > margin).alias("non_inferior"))


def hajek(df: DataFrame, policies: dict[str, Column], propensity: float = 0.5) -> DataFrame:
    """Normalised and plain inverse-propensity values of policies (each a column: the arm)."""
    outs = []
    for name, arm in policies.items():
        w = F.when(F.col("a") == arm, 1 / propensity).otherwise(0.0)
        outs.append(F.struct(F.lit(name).alias("policy"), F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("hajek"), F.try_divide(F.sum(w * F.col("y")), F.count(F.lit(1))).alias("ipw")))
    return df.agg(F.array(*outs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def cross_fit(df: DataFrame, propensity: float = 0.5) -> DataFrame:
    """Doubly robust values of both arms, each cluster's means from the other clusters.

    Means of the others are totals less the cluster's own; where a stratum's arm has no
    other cluster, the arm's mean over all strata, else the mean of all, takes its place.
    """
    y = F.col("y")
    cell = df.groupBy("cluster", "stratum", "a").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    out = {}
    for name, keys in (("cell", ("stratum", "a")), ("arm", ("a",)), ("all", ())):
        own = cell.groupBy("cluster", *keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        whole = cell.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
        out[name] = (own, whole)
    clusters = cell.select("cluster").distinct()
    arms = cell.select("stratum").distinct().crossJoin(cell.select("a").distinct())  # strata times arms: a handful
    grid = clusters.join(F.broadcast(arms))
    for name, keys in (("cell", ("stratum", "a")), ("arm", ("a",)), ("all", ())):
        own, whole = out[name]
        grid = grid.join(F.broadcast(whole.withColumnsRenamed({"ts": f"{name}_ts", "tn": f"{name}_tn"})), list(keys), "left") if keys else grid.join(F.broadcast(whole.withColumnsRenamed({"ts": "all_ts", "tn": "all_tn"})))
        grid = grid.join(own.withColumnsRenamed({"s": f"{name}_s", "n": f"{name}_n"}), ["cluster", *keys], "left")
    rest = lambda n: F.try_divide(F.col(f"{n}_ts") - F.coalesce(f"{n}_s", F.lit(0.0)), F.col(f"{n}_tn") - F.coalesce(f"{n}_n", F.lit(0)))
    mu = grid.select("cluster", "stratum", F.col("a").alias("arm"), F.coalesce(rest("cell"), rest("arm"), rest("all")).alias("mu"))
    scored = df.join(mu, ["cluster", "stratum"])
    value = F.col("mu") + F.when(F.col("a") == F.col("arm"), (y - F.col("mu")) / propensity).otherwise(0.0)
    return scored.groupBy("arm").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """The difference in means without each group, from totals."""
    g = df.groupBy(group).agg(*(f(F.when(F.col("a") == k, F.col("y"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("s", F.sum), ("n", F.count))))
    t = g.agg(*(F.sum(f"{n}{k}").alias(f"t{n}{k}") for k in (0, 1) for n in "sn"))
    rest = lambda n, k: F.col(f"t{n}{k}") - F.coalesce(F.col(f"{n}{k}"), F.lit(0))
    return g.join(F.broadcast(t)).where((rest("n", 0) > 0) & (rest("n", 1) > 0)).select(group, (rest("s", 1) / rest("n", 1) - rest("s", 0) / rest("n", 0)).alias("diff"))


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Spearman correlation with ordinal ranks (equals by ``tie``).

    Ranks are places in a total order of the rows, part by part.
    """
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(tie).alias("_tie"))
    r = ranks.place(ranks.place(r, ["_x", "_tie"], "rx"), ["_y", "_tie"], "ry")
    n = F.count(F.lit(1)).cast("double")
    d = (F.col("rx") - F.col("ry")).cast("double")
    return r.agg((1 - F.try_divide(6 * F.sum(d * d), n * (n * n - 1))).alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_within(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Average-rank Spearman correlation of each group."""

    def rank(c: str) -> Column:
        w = Window.partitionBy(group)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1) / 2

    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, rank(x).alias("rx"), rank(y).alias("ry"))
    return r.groupBy(group).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def benjamini_hochberg(df: DataFrame, name: str, p: str) -> DataFrame:
    """Adjusted p-values of a family of tests (a row for each test)."""
    w = Window.orderBy(p, name)
    ranked = df.withColumn("r", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    q = F.min(F.col(p) * F.col("m") / F.col("r")).over(Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(name, p, F.least(q, F.lit(1.0)).alias("q"))


def moments(df: DataFrame, *by: str, value: str = "y") -> DataFrame:
    """Shape of a value: null where a group's median, mean or spread is zero."""
    shape = df.groupBy(*by).agg(F.max(value).alias("_max"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"), F.stddev_pop(value).alias("sd"), F.stddev_samp(value).alias("sd_sample"))
    return ranks.with_quantiles(df, shape, list(by), value, _median=0.5).withColumn("max_over_median", F.try_divide("_max", "_median")).drop("_max", "_median")


def auroc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores; equals count half."""
    c = df.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    w = ranks.running(c, [score], F.col("n"), "below")
    return w.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) from the columns' SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(c.cast("string") for c in columns)), 256), 1, 8), 16, 10).cast("double") / 2.0**32


def cluster_bootstrap(df: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Percentile interval of the difference in means, resampling clusters; draws without
    both arms don't count."""
    y = lambda k: F.when(F.col("a") == k, F.col("y"))
    sums = {"s0": F.sum(y(0)), "s1": F.sum(y(1)), "n0": F.count(y(0)), "n1": F.count(y(1))}
    return bootstrap(df, "cluster", sums, F.try_divide("s1", "n1") - F.try_divide("s0", "n0"), draws, seed)


def bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], statistic: Column, draws: int, seed: int = 0) -> DataFrame:
    """Percentile interval of any statistic of the clusters' sums.

    Each cluster is summed once; a draw takes as many clusters as there are, with
    replacement, by the hashes of its slots, so no row is copied and draws run in parallel.
    Draws without a value don't count.
    """
    g = df.groupBy(F.col(cluster).alias("cluster")).agg(*(c.alias(n) for n, c in sums.items()))
    numbered = ranks.place(g, ["cluster"], "slot").withColumn("slot", F.col("slot") - 1)
    size = g.agg(F.count(F.lit(1)).alias("clusters"))
    slots = numbered.select("slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).join(F.broadcast(size))
    picks = slots.select("draw", F.floor(uniform(F.lit(seed), F.col("draw"), F.col("slot")) * F.col("clusters")).cast("long").alias("slot")).groupBy("draw", "slot").agg(F.count(F.lit(1)).alias("k"))
    s = picks.join(numbered, "slot").groupBy("draw").agg(*(F.sum(F.col("k") * F.coalesce(n, F.lit(0))).alias(n) for n in sums))
    return s.select(statistic.alias("d")).dropna().agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws"))


def block_permutation(df: DataFrame, block: str, draws: int, seed: int = 0) -> DataFrame:
    """p-value of the block-adjusted effect: arms are permuted inside blocks by hash order.

    A draw gives arm 1 to as many units of a block as were observed in it, those of the least
    hashes.  Counts and sums by ``SLOTS`` equal slots of the hashes say which slots lie on one
    side of that border as a whole; only the slot on the border is put in order, so neither a
    block nor a draw meets in one task.
    """
    rows = df.select(F.col("unit"), F.col(block).alias("block"), "a", "y")
    sums = lambda one, zero: (F.sum(F.when(one, F.col("s"))).alias("s1"), F.sum(F.when(one, F.col("c"))).alias("c1"), F.sum(F.when(zero, F.col("s"))).alias("s0"), F.sum(F.when(zero, F.col("c"))).alias("c0"))
    value = (F.sum("y").alias("s"), F.count("y").alias("c"), F.count(F.lit(1)).alias("n"))
    key = uniform(F.lit(seed), F.col("draw"), F.col("unit"))
    slot = F.floor(key * SLOTS).cast("int")
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw")).where("draw > 0")
    slots = drawn.groupBy("draw", "block", slot.alias("slot")).agg(*value, F.sum("a").alias("k"))
    whole, upto = Window.partitionBy("draw", "block"), Window.partitionBy("draw", "block").orderBy("slot")
    slots = slots.withColumns({"k": F.sum("k").over(whole), "upto": F.sum("n").over(upto)}).withColumn("before", F.col("upto") - F.col("n"))
    one, zero = F.col("upto") <= F.col("k"), F.col("before") >= F.col("k")
    sure = slots.groupBy("draw", "block").agg(*sums(one, zero), F.sum("n").alias("n"))
    border = slots.where(~one & ~zero).groupBy("block").agg(F.collect_list(F.struct("draw", "slot", (F.col("k") - F.col("before")).alias("rest"))).alias("border"))  # at most a slot a draw
    border = border.withColumnRenamed("block", "_block")
    split = rows.join(border, F.col("block").eqNullSafe(F.col("_block"))).select("unit", "block", "y", F.explode("border").alias("b")).select("unit", "block", "y", "b.draw", "b.slot", "b.rest").where(slot == F.col("slot"))
    split = split.withColumn("first", F.row_number().over(whole.orderBy(key, "unit")) <= F.col("rest")).groupBy("draw", "block", "first").agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    split = split.groupBy("draw", "block").agg(*sums(F.col("first"), ~F.col("first")), F.lit(0).cast("long").alias("n"))
    observed = rows.groupBy(F.lit(0).alias("draw"), "block", "a").agg(*value).groupBy("draw", "block").agg(*sums(F.col("a") == 1, F.col("a") == 0), F.sum("n").alias("n"))  # draw 0
    cells = sure.unionByName(split).unionByName(observed).groupBy("draw", "block").agg(*(F.sum(c).alias(c) for c in ("s1", "c1", "s0", "c0", "n")))
    cells = cells.select("draw", F.try_divide("s1", "c1").alias("m1"), F.try_divide("s0", "c0").alias("m0"), "n").where("m1 is not null and m0 is not null")
    ate = cells.groupBy("draw").agg((F.sum((F.col("m1") - F.col("m0")) * F.col("n")) / F.sum("n")).alias("t"))
    seen = F.max(F.when(F.col("draw") == 0, F.col("t"))).over(Window.partitionBy())
    w = ate.withColumn("seen", seen).where("draw > 0")
    return w.agg(((F.count_if(F.abs("t") >= F.abs("seen") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.max("seen").alias("ate"), F.count(F.lit(1)).alias("draws"))


def ols(df: DataFrame, y: str, x: list[str], cluster: str) -> DataFrame:
    """Coefficients with classical, HC0, HC3 and cluster-robust standard errors.

    One pass adds up the Gram matrix by cluster; a second adds up scores.  Both are a
    few numbers for each cluster, so the rows never leave their tasks.
    """
    k = len(x) + 1
    names = ["intercept", *x]
    design = df.select(F.col(cluster).cast("string").alias("c"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(x))).dropna()
    cols = [f"x{i}" for i in range(k)]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in cols]
    g = design.agg(*sums, F.count(F.lit(1)).alias("n")).first().asDict()  # one row
    if not g["n"]:
        return df.sparkSession.createDataFrame([], "term string, coef double, se double, se_hc0 double, se_hc3 double, se_cluster double, n long")
    gram = np.array([[g[f"x{min(i, j)}_x{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.pinv(gram) @ np.array([g[f"{a}_y"] for a in cols])
    inverse = np.linalg.pinv(gram)
    fitted = sum((F.col(c) * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
    leverage = sum((F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols)), F.lit(0.0))
    r = design.withColumns({"e": F.col("y") - fitted, "d": F.greatest(1 - leverage, F.lit(1e-12))})
    e, e3 = F.col("e"), F.col("e") / F.col("d")
    meat = r.groupBy("c").agg(*(F.sum(e * F.col(a)).alias(f"s{i}") for i, a in enumerate(cols)), *(F.sum(e * e * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(e3 * e3 * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)), F.sum(e * e).alias("ee"))
    total = meat.agg(*(F.sum(f"{p}{i}_{j}").alias(f"{p}{i}_{j}") for p in "hq" for i in range(k) for j in range(i, k)), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), F.sum("ee").alias("ee"), F.count(F.lit(1)).alias("clusters")).first().asDict()
    full = lambda p: np.array([[total[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n, m = g["n"], total["clusters"]
    se = lambda v: np.sqrt(np.maximum(np.diag(v), 0))
    classical = se(inverse * total["ee"] / max(n - k, 1))
    hc0 = se(inverse @ full("h") @ inverse)
    hc3 = se(inverse @ full("q") @ inverse)
    adjust = m / max(m - 1, 1) * (n - 1) / max(n - k, 1)
    clustered = se(inverse @ full("m") @ inverse * adjust)
    rows = pd.DataFrame({"term": names, "coef": beta, "se": classical, "se_hc0": hc0, "se_hc3": hc3, "se_cluster": clustered, "n": n})
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, se_hc0 double, se_hc3 double, se_cluster double, n long")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each two columns, and which is the greatest off the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    most = F.greatest(*(F.col(f"`{a}|{b}`") for a, b in pairs)) if len(pairs) > 1 else F.col(f"`{pairs[0][0]}|{pairs[0][1]}`")
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"), (F.col(f"`{a}|{b}`") == most).alias("most")) for a, b in pairs))
    return one.select(F.explode(rows).alias("p")).select("p.*")


def robust_means(df: DataFrame, tail: float) -> DataFrame:
    """Each arm's mean with both tails pulled in to their quantiles or cut off, the mean of
    log(1 + y), and the median."""
    q = ranks.quantiles(df, [], "y", lo=tail, hi=1 - tail)
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    means = df.join(F.broadcast(q)).groupBy("a").agg(F.avg(F.least(F.greatest(y, lo), hi)).alias("winsorised"), F.avg(F.when(y.between(lo, hi), y)).alias("trimmed"), F.avg(F.log1p(y)).alias("log_mean"))
    return ranks.with_quantiles(df, means, ["a"], "y", median=0.5)


def in_sample_dr(df: DataFrame, propensity: float = 0.5) -> DataFrame:
    """Doubly robust values of both arms with means of the strata they are scored in."""
    y = F.col("y")
    mu = df.groupBy("stratum").agg(*(F.avg(F.when(F.col("a") == k, y)).alias(f"m{k}") for k in (0, 1)))
    s = df.join(F.broadcast(mu), "stratum").where("m0 is not null and m1 is not null")
    value = lambda k: F.avg(F.col(f"m{k}") + F.when(F.col("a") == k, (y - F.col(f"m{k}")) / propensity).otherwise(0.0))
    return s.agg(value(1).alias("value_1"), value(0).alias("value_0"), F.count(F.lit(1)).alias("n"))
