"""Cost ledgers: roll-ups, paired comparisons, regressions, frontiers, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import risk_tier, wilson_upper
from . import ranks


def task_cost(calls: DataFrame, *keys: str) -> DataFrame:
    """Cost, calls, changed calls and removed characters of each task (and method)."""
    named = calls.where(F.col("task_id").isNotNull() & ~F.col("task_id").cast("string").rlike("^(UNKNOWN|NO_)"))
    keys = keys or ("task_id", "method")
    if keys[0] == "task_id":
        named = named.repartition("task_id")  # calls of a task are few: later windows by task need no shuffle again
    return named.groupBy(*keys).agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"), F.count_if("changed").alias("changed_calls"),
        F.sum(F.when(F.col("changed"), F.col("chars_removed")).otherwise(0)).alias("chars_removed"),
    )


def paired(costs: DataFrame, baseline: str, *keep: str) -> DataFrame:
    """Each task's candidate costs beside its baseline cost, and the saving in percent.

    A window by task finds the baseline; ``task_cost`` has dealt the calls by task, so it
    costs no shuffle of its own.
    """
    base = F.max(F.when(F.col("method") == baseline, F.col("cost"))).over(Window.partitionBy("task_id"))
    both = costs.withColumn("base", base).where((F.col("method") != baseline) & (F.col("base") > 0))
    return both.select("task_id", "method", "base", "cost", (100 * (F.col("base") - F.col("cost")) / F.col("base")).alias("saving"), *keep)


def outcome_counts(grades: DataFrame, *keys: str) -> DataFrame:
    """Regressions, improvements and the loss bound among tasks the baseline solved."""
    base, cand = F.col("baseline"), F.col("candidate")
    agg = grades.groupBy(*keys).agg(F.count_if(base & ~cand).alias("regressions"), F.count_if(~base & cand).alias("improvements"), F.count_if(base).alias("solved"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("loss_ub", wilson_upper(F.col("regressions"), F.col("solved")))


def frontier(savings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Methods by median saving, with risk tier and verdict; ``outcomes`` is one row a
    method, or a single row (without a method) that holds for all."""
    s = ranks.quantiles(savings, ["method"], "saving", median_saving=0.5, mean_saving=ranks.mean(), pairs=F.sum("_n"))
    outcomes = outcomes.select(*(c for c in ("method", "regressions", "loss_ub") if c in outcomes.columns))
    joined = s.join(outcomes, "method") if "method" in outcomes.columns else s.join(F.broadcast(outcomes))
    verdict = F.when((F.col("median_saving") > 2) & (F.col("loss_ub") <= 0.10), "win").when(F.col("median_saving") > 0, "marginal").otherwise("no saving")
    rank = F.row_number().over(Window.orderBy(F.desc("median_saving"), "method"))  # a row for each method
    return joined.select("method", "pairs", "median_saving", "mean_saving", "regressions", "loss_ub", risk_tier(F.col("regressions"), F.col("loss_ub")).alias("tier"), verdict.alias("verdict"), rank.alias("rank"))


def leave_top_out(pairs: DataFrame, ks: tuple[int, ...] = (0, 1, 3, 5)) -> DataFrame:
    """Total saving of each method without its k most expensive tasks.

    Only the greatest k costs of a method are looked at; totals do the rest.
    """
    most = max(ks)
    totals = pairs.groupBy("method").agg(F.sum("base").alias("b"), F.sum("cost").alias("c"))
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("base"), "task_id"))
    top = pairs.withColumn("rn", rank).where(F.col("rn") <= most).groupBy("method").agg(*(F.sum(F.when(F.col("rn") <= k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in ks for c in ("base", "cost")))
    rows = totals.join(top, "method").select("method", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("b") - F.col(f"base_{k}")).alias("base"), (F.col("c") - F.col(f"cost_{k}")).alias("cost")) for k in ks))).alias("r"))
    return rows.select("method", "r.k", F.try_divide(100 * (F.col("r.base") - F.col("r.cost")), F.col("r.base")).alias("saving"))


def policies(pairs: DataFrame, threshold: float) -> DataFrame:
    """Total cost of the baseline, the candidate, the better of both, and the candidate
    where the baseline's cost reaches the threshold."""
    gated = F.when(F.col("base") >= threshold, F.col("cost")).otherwise(F.col("base"))
    return pairs.groupBy("method").agg(F.sum("base").alias("baseline"), F.sum("cost").alias("candidate"), F.sum(F.least("base", "cost")).alias("oracle"), F.sum(gated).alias("gated"))


def reprice(calls: DataFrame, schemes: dict[str, tuple]) -> DataFrame:
    """Totals of each method under several weight vectors, in one pass: the components
    are summed first and weighted after."""
    parts = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    sums = calls.groupBy("method").agg(*(F.sum(p).alias(p) for p in parts))
    return sums.select("method", F.explode(F.array(*(F.struct(F.lit(n).alias("scheme"), sum((F.col(p) * w for p, w in zip(parts, ws, strict=True)), F.lit(0.0)).alias("cost")) for n, ws in schemes.items()))).alias("s")).select("method", "s.*")


def decomposition(calls: DataFrame, weights: tuple) -> DataFrame:
    """Each token component's part of a method's cost."""
    parts = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    sums = calls.groupBy("method").agg(*((F.sum(p) * w).alias(p) for p, w in zip(parts, weights, strict=True)))
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return sums.select("method", *(F.try_divide(F.col(p), total).alias(p.replace("_tokens", "_share")) for p in parts))


def cache_ratio(calls: DataFrame) -> DataFrame:
    return calls.groupBy("method").agg((F.sum("cache_read_tokens") / F.greatest(F.sum("cache_creation_tokens"), F.lit(1.0))).alias("ratio"), F.count(F.lit(1)).alias("calls"))


def relational_division(df: DataFrame, item: str, of: str) -> DataFrame:
    """Items that occur with every value of ``of``."""
    all_ = df.agg(F.count_distinct(of).alias("k"))
    return df.groupBy(item).agg(F.count_distinct(of).alias("n")).join(F.broadcast(all_), F.col("n") == F.col("k")).select(item)


def overlap(df: DataFrame, item: str, of: str) -> DataFrame:
    """Items shared by each two values of ``of`` (few values, so sets are small)."""
    sets = df.groupBy(item).agg(F.array_sort(F.collect_set(of)).alias("s"))
    pair = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a <= b")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def quantile_cap(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Rows at or above their group's linear quantile."""
    cut = ranks.quantiles(df, [group], value, cut=q)
    return df.join(cut, group).where(F.col(value) >= F.col("cut")).groupBy(group).agg(F.max("cut").alias("cut"), F.count(F.lit(1)).alias("n"))


def exclusive_tertiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tertile cuts by the exclusive method: place i (n + 1) / 3, linear between neighbours."""

    def cut(i: int) -> Column:
        n = F.col("_rows")
        whole = F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 3), F.lit(1)), n - 1)
        part = F.max(F.lit(i) * (n + 1) - whole * 3)
        return (ranks.at(whole - 1) * (3 - part) + ranks.at(whole) * part) / 3

    return ranks.sorted_counts(df, [group], value).where("_rows > 1").groupBy(group).agg(cut(1).alias("low"), cut(2).alias("high"))


def mode(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equals, the one seen first."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))
    return c.withColumn("rn", best).where("rn = 1").select(group, value, "n")


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the total sum of squares, from sums alone."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(value).alias("n"))
    t = g.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return t.select(((F.col("b") - mean) / F.nullif(F.col("q") - mean, F.lit(0.0))).alias("eta_sq"))


def stratified_sample(df: DataFrame, stratum: str, unit: str, size: int) -> DataFrame:
    """Round-robin sample: the first unit of every stratum, rare strata first, then the
    second of each, and so on; units in the order of their hashes."""
    h = F.sha2(F.col(unit).cast("string"), 256)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(h, unit))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    return df.withColumn("round", place).withColumn("_n", n).orderBy("round", "_n", stratum, unit).limit(size).select(unit, stratum, "round")


def group_folds(df: DataFrame, unit: str, folds: int) -> DataFrame:
    """The fold of each unit, by hash: rows of a unit never part."""
    digits = F.conv(F.substring(F.sha2(F.col(unit).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(digits, F.lit(folds)).cast("int"))


def split_leaks(split: DataFrame, unit: str, part: str) -> DataFrame:
    """Units that stand in more than one part of a split."""
    return split.groupBy(unit).agg(F.count_distinct(part).alias("parts"), F.array_join(F.array_sort(F.collect_set(part)), ",").alias("names")).where("parts > 1")


def assignment_conflicts(df: DataFrame, key: str, arm: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(arm).alias("arms")).where("arms > 1")


def index_tertiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """The values at places n // 3 and 2n // 3 (from 0) of each group's sorted values."""
    at = lambda i: ranks.at(F.floor(F.col("_rows") * i / 3))
    return ranks.sorted_counts(df, [group], value).groupBy(group).agg(at(1).alias("low"), at(2).alias("high"))


def reduction_totals(pairs: DataFrame) -> DataFrame:
    """Each method's saving weighted by bill, and the mean and median over tasks."""
    bill = F.try_divide(100 * (F.sum("base") - F.sum("cost")), F.sum("base"))
    return ranks.with_quantiles(pairs, pairs.groupBy("method").agg(bill.alias("bill_weighted"), F.avg("saving").alias("task_mean")), ["method"], "saving", task_median=0.5)


def creation_share(calls: DataFrame, least: float) -> DataFrame:
    """Cache creation's share of a task's prompt tokens, where these are more than ``least``."""
    total = F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens"))
    s = calls.groupBy("task_id", "method").agg(F.sum("cache_creation_tokens").alias("cc"), total.alias("total"))
    return s.where(F.col("total") > least).select("task_id", "method", (F.col("cc") / F.col("total")).alias("share"))


def dose_bins(pairs: DataFrame, dose: str, cuts: tuple[float, ...]) -> DataFrame:
    """Savings by method and half-open bin of the dose: below the first cut is bin 0."""
    bin_ = sum(((F.col(dose) >= c).cast("int") for c in cuts), F.lit(0))
    return ranks.quantiles(pairs.withColumn("bin", bin_), ["bin", "method"], "saving", n=F.sum("_n"), median_saving=0.5, mean_saving=ranks.mean())


def decision_events(calls: DataFrame, first: Column) -> DataFrame:
    """Calls by what happened and by what their counterfactual is: only a task's pair tells
    it for its first call and where nothing fired."""
    event = F.when(F.col("changed"), "FIRED").otherwise("NO_OP_ELIGIBLE")
    told = F.when(first | ~F.col("changed"), "PAIRED_TASK_ONLY").otherwise("UNIDENTIFIED")
    return calls.groupBy("method", event.alias("event"), told.alias("counterfactual")).agg(F.count(F.lit(1)).alias("n"))


def inventory(ledgers: list[DataFrame], task: str) -> DataFrame:
    """What the methods' ledgers, put together, hold: calls, unknown ones, tasks, raw tokens,
    and the mean prompt of the calls that have one."""
    calls = ledgers[0]
    for other in ledgers[1:]:
        calls = calls.unionByName(other)
    unknown = F.col(task).isNull() | F.col(task).rlike("^(UNKNOWN|NO_)")
    prompt = F.col("input_tokens") + F.col("cache_read_tokens")
    return calls.groupBy("method").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(unknown).alias("unknown_calls"), F.count_distinct(F.when(~unknown, F.col(task))).alias("tasks"),
        F.sum(prompt + F.col("cache_creation_tokens")).alias("input_side"), F.sum("output_tokens").alias("output"), F.avg(F.when(prompt > 0, prompt)).alias("mean_prompt"),
    )


def mechanism(calls: DataFrame, arm: str) -> DataFrame:
    """Both arms' means of each token component, from one aggregate."""
    parts = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    sums = calls.agg(*(F.avg(F.when(F.col(arm) == k, F.col(p))).alias(f"{p}_{int(k)}") for p in parts for k in (True, False)))
    rows = F.array(*(F.struct(F.lit(p).alias("component"), F.col(f"{p}_1").alias("mean_1"), F.col(f"{p}_0").alias("mean_0")) for p in parts))
    return sums.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.mean_1") - F.col("r.mean_0")).alias("diff"))
