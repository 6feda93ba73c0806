"""Samples, splits, audits, gates and verdicts over tables of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Least agreement of each gate.
GATE = 0.67
#: Percent of saving from which a method helps or hurts.
BAND = 5.0


def _hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)


def catalogue(units: DataFrame, source: str, unit: str, allowed: Column, limit: int | None) -> DataFrame:
    """Units of allowed sources, at most ``limit`` of each in the order of their ids."""
    kept = units.where(allowed)
    return kept if limit is None else kept.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(unit))).where(F.col("place") <= limit)


def split_by_group(units: DataFrame, group: str, solver: str, held_out: str) -> DataFrame:
    """``units`` with their part: groups in the order of their hashes give a fifth to test,
    the next tenth to validation (one group each at least), the others to train; units of
    the held-out solver are in none of these, they test the transfer to another model."""
    groups = units.select(group).where(F.col(group).isNotNull()).distinct()
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    ranked = groups.withColumn("r", F.row_number().over(Window.orderBy(_hash(group), group)) - 1).join(F.broadcast(n))  # a row for each group
    fifth, tenth = F.floor(F.col("n") / 5), F.floor(F.col("n") / 10)
    part = F.when(F.col("r") < F.greatest(F.lit(1), fifth), "test").when((F.col("r") >= fifth) & (F.col("r") < fifth + F.greatest(F.lit(1), tenth)), "validation").otherwise("train")
    parts = F.broadcast(ranked.select(group, part.alias("part")))
    of_unit = F.when(F.col(solver) == held_out, "model_transfer_test").otherwise(F.coalesce("part", F.lit("train")))
    return units.join(parts, group, "left").withColumn("part", of_unit)


def split_audit(split: DataFrame, held_out: str) -> DataFrame:
    """The five leaks of a split (part, trace, task, base, solver, repo) and how many
    traces, tasks, bases, traces and repositories each has; 0 everywhere if it is clean."""

    def shared(name: str, column: str, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
        sides = split.where(F.col("part").isin(*left, *right) & F.col(column).isNotNull()).groupBy(column).agg(F.max(F.col("part").isin(*left)).alias("l"), F.max(F.col("part").isin(*right)).alias("r"))
        return sides.agg(F.count_if(F.col("l") & F.col("r")).alias("violations")).select(F.lit(name).alias("audit"), "violations")

    parts = split.where(F.col("part").isin("train", "validation", "test")).groupBy("trace").agg(F.count_distinct("part").alias("k"))
    checks = [
        parts.agg(F.count_if(F.col("k") > 1).alias("violations")).select(F.lit("trace_overlap").alias("audit"), "violations"),
        shared("task_overlap", "task", ("train",), ("test",)),
        shared("base_overlap", "base", ("train",), ("test", "validation")),
        split.where("part = 'train'").agg(F.count_if(F.col("solver") == held_out).alias("violations")).select(F.lit("held_out_in_train").alias("audit"), "violations"),
        shared("repo_transfer_overlap", "repo", ("train",), ("repo_transfer_test",)),
    ]
    return reduce(DataFrame.unionByName, checks)


def audit_sample(units: DataFrame, unit: str, cell: str, axis: str, quota: int, size: int) -> DataFrame:
    """Three passes of hash order: one unit of each cell, then up to ``quota`` more of each
    axis, then whatever comes next, ``size`` at most; the pass that took a unit is kept.

    All passes run over the few rows that they can take: the first of each cell (of these the
    first ``size``, more can't be in the sample), ``quota + size`` of each axis and
    ``2 * size`` of all, as at most ``size`` of them are taken by an earlier pass.  Each task
    cuts its rows to that before they meet (up to ``quota + size`` of 1,000, where Spark's
    spark.sql.optimizer.windowGroupLimitThreshold ends)."""
    columns = (unit, cell, axis)
    order = (_hash(unit), *(F.col(c) for c in columns))
    least = lambda group, k: units.select(*columns, F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("_place")).where(F.col("_place") <= k).select(*columns)
    some = (least(cell, 1).orderBy(*order).limit(size), least(axis, quota + size), units.select(*columns).orderBy(*order).limit(2 * size))
    counted = reduce(DataFrame.unionByName, (d.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")) for d in some)).groupBy(*columns).agg(F.max("_n").alias("_n"))
    few = counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_place")).drop("_place")  # equal rows as often as they are there
    in_cell = F.row_number().over(Window.partitionBy(cell).orderBy(*order))
    first = few.withColumn("taken", F.when(in_cell == 1, 1))
    in_axis = F.row_number().over(Window.partitionBy(axis, F.col("taken").isNull()).orderBy(*order))
    second = first.withColumn("taken", F.coalesce("taken", F.when(in_axis <= quota, 2), F.lit(3)))
    return second.orderBy("taken", *order).limit(size).select(*columns, "taken")


def pools(units: DataFrame, unit: str, size: int) -> DataFrame:
    """Two disjoint pools of ``size`` units, the first and next in the order of their hashes."""
    ordered = units.select(unit).distinct().orderBy(_hash(unit), unit).limit(2 * size)
    place = F.row_number().over(Window.orderBy(_hash(unit), unit))  # 2 * size rows
    return ordered.withColumn("pool", F.when(place <= size, "calibration").otherwise("evaluation"))


def pair_votes(one: DataFrame, two: DataFrame, unit: str) -> DataFrame:
    """Both raters' votes side by side, null where one has none."""
    name = lambda d, k: d.select(unit, *(F.col(c).alias(f"{c}_{k}") for c in d.columns if c != unit))
    return name(one, 1).join(name(two, 2), unit, "full")


def align(left: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """How many rows of ``left`` have a text that ``right`` has too, by content hash."""
    h = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 16)
    keys = right.select(h.alias("h")).distinct().withColumn("hit", F.lit(True))
    return left.select(h.alias("h")).join(keys, "h", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


def pooled(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several sets, of equal keys only the one of the first set that has it."""
    parts = [d.select(F.lit(i).alias("place"), F.lit(name).alias("from_set"), key) for i, (name, d) in enumerate(sets.items())]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(F.struct("place", "from_set")).alias("f")).select(key, F.col("f.from_set").alias("from_set"))


def assertions(checks: dict[str, DataFrame]) -> DataFrame:
    """name, passed, detail of checks; each is a frame of one row (passed, detail)."""
    return reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("name"), F.col("passed"), F.col("detail").cast("string").alias("detail")) for name, d in checks.items()))


def gate_value(alpha: Column, raw: Column) -> Column:
    """A zero alpha counts as missing, as does a zero raw agreement."""
    return F.coalesce(F.nullif(alpha, F.lit(0.0)), F.nullif(raw, F.lit(0.0)), F.lit(0.0))


def evidence_overlap(votes: DataFrame) -> DataFrame:
    """Jaccard similarity of two raters' evidence (unit, rater, label, evidence: array) for
    labels that both gave; labels without any evidence don't count."""
    v = votes.groupBy("unit", "label").agg(F.sort_array(F.collect_list(F.struct("rater", "evidence"))).alias("v")).where(F.size("v") == 2)  # a unit has few raters
    a, b = F.col("v")[0]["evidence"], F.col("v")[1]["evidence"]
    union = F.size(F.array_union(a, b))
    return v.where(union > 0).select("unit", "label", (F.size(F.array_intersect(a, b)) / union).alias("overlap"))


def saving_tag(name: str, saving: Column) -> Column:
    return F.when(saving > BAND, f"{name}_helped").when(saving < -BAND, f"{name}_hurt").when(saving.isNotNull(), f"{name}_neutral")


def contrast_tags(pairs: DataFrame, names: dict[str, str], costly: float) -> DataFrame:
    """Each task's tags: what each method did to its cost, and whether it is costly."""
    s = pairs.groupBy("task_id").agg(F.max("base").alias("base"), *(F.max(F.when(F.col("method") == m, F.col("saving"))).alias(f"s_{m}") for m in names))
    tags = F.array_compact(F.array(*(saving_tag(n, F.col(f"s_{m}")) for m, n in names.items()), F.when(F.col("base") > costly, "high_cost").otherwise("ordinary_cost")))
    return s.select("task_id", tags.alias("tags"))


def task_classes(reps: DataFrame) -> DataFrame:
    """The class of each task from repeated outcomes (task, arm: control, sham or method,
    rep, passed, fired), in this order: unstable by itself, different without any firing,
    fragile, improved, unchanged; INCONCLUSIVE otherwise or if an arm is missing."""
    of = lambda arm: F.transform(F.array_sort(F.collect_list(F.when(F.col("arm") == arm, F.struct("rep", "passed")))), lambda r: r["passed"])
    t = reps.groupBy("task").agg(of("control").alias("c"), of("sham").alias("s"), of("method").alias("m"), F.count_if((F.col("arm") == "method") & F.col("fired")).alias("fired"))  # a task has few repetitions
    stable = lambda c: F.size(F.array_distinct(c)) == 1
    mean = lambda c: F.size(F.filter(c, lambda x: x)) / F.size(c)
    c, s, m, fired = F.col("c"), F.col("s"), F.col("m"), F.col("fired")
    kind = (
        F.when((F.size(c) == 0) | (F.size(s) == 0) | (F.size(m) == 0), "INCONCLUSIVE").when(~stable(c) | ~stable(s), "INHERENTLY_UNSTABLE")
        .when((fired == 0) & (m != c), "NO_OP_FALSE_ATTRIBUTION").when((mean(c) > 0.5) & (mean(m) < 0.5) & (fired > 0), "TRUE_PRUNING_FRAGILITY")
        .when((mean(c) <= 0.5) & (mean(m) > 0.5) & (fired > 0), "TRUE_PRUNING_IMPROVEMENT").when(m == c, "STABLE_NO_EFFECT").otherwise("INCONCLUSIVE")
    )
    return t.select("task", kind.alias("task_class"))


def blind_verdict(action: Column, predicted: Column, dedup: Column, cap: Column) -> Column:
    """Was the predicted effect of a preferred action borne out by the savings of two methods?"""
    realised = F.when(action == "LINE_DEDUP", dedup).when(action == "GENTLE_CAP", cap)
    keep = F.when(dedup.isNull() | cap.isNull(), "UNIDENTIFIED").when(F.greatest(dedup, cap) <= BAND, "VALIDATED_CANDIDATE").otherwise("REJECTED")
    toward = lambda x: F.when(x > BAND, "VALIDATED_CANDIDATE").when(x < -BAND, "REJECTED").otherwise("CONDITIONALLY_VALID")
    neutral = F.when(F.abs(realised) <= BAND, "VALIDATED_CANDIDATE").otherwise("CONDITIONALLY_VALID")
    return (
        F.when(action.isin("NO_OP", "KEEP_FULL_CONTENT"), keep).when(~action.isin("LINE_DEDUP", "GENTLE_CAP"), "UNIDENTIFIED").when(realised.isNull(), "INSUFFICIENT_COUNTERFACTUAL")
        .when(predicted == "decrease", toward(realised)).when(predicted == "increase", toward(-realised)).otherwise(neutral)
    )


def kill_tier(regressions: Column, saving: Column, loss_ub: Column, full: bool, delta: float = 0.10) -> Column:
    """The verdict of a screening run, or of a full one."""
    if not full:
        return F.when((regressions >= 2) | (saving <= 0), "KILL").when(saving > 0, "PROCEED_TO_FULL").otherwise("WEAK")
    return F.when((loss_ub <= delta) & (saving > 0), "GLOBAL_SAFE").when(regressions > 0, "UNSAFE").otherwise("INCONCLUSIVE")


def saving_per_regression(methods: DataFrame) -> DataFrame:
    """``methods`` (method, saving, regressions) with saving per regression (null without
    any) and rank: those without regressions by saving, the others by saving per regression."""
    ratio = F.when(F.col("regressions") > 0, F.col("saving") / F.greatest(F.col("regressions"), F.lit(1)))
    rank = F.row_number().over(Window.orderBy(F.desc(F.coalesce(ratio, F.col("saving"))), "method"))  # a row for each method
    return methods.withColumns({"per_regression": ratio, "rank": rank})


def flips(reps: DataFrame, unit: str, outcome: Column, cost: str) -> DataFrame:
    """Units whose repeated outcomes differ, their share, and the mean of costs' variation."""
    u = reps.groupBy(unit).agg(F.count_distinct(outcome).alias("k"), F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_samp(cost), F.avg(cost)).alias("cv")).where("n > 1")
    return u.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("k") > 1).alias("unstable"), F.try_divide(F.count_if(F.col("k") > 1), F.count(F.lit(1))).alias("flip_rate"), F.avg("cv").alias("mean_cv"))


def blind(text: Column, rules: list[tuple[str, str]]) -> Column:
    """``text`` after all (pattern, replacement) rules, in their order."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def still_named(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Does a rule still find something?  After ``blind`` it must not."""
    return reduce(lambda a, b: a | b, (F.coalesce(text.rlike(p), F.lit(False)) for p, _ in rules))
