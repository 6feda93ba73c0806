"""Blocked designs and their null tests, model metrics, dose control, verdicts, opportunity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .statistics import bootstrap, spearman, uniform

# --- fixed values -----------------------------------------------------------
#: What may stand for each kind of waste, by features of a trace.
PROXIES = {
    "REDUNDANT_FILE_REREAD": "duplicate_file_reads >= 2",
    "CONTEXT_BLOAT": "duplicate_file_reads >= 2",
    "FILENAME_SEARCH_THRASH": "unique_files_searched >= 10",
    "SEARCH_WITHOUT_NEW_EVIDENCE": "exact_duplicate_call_rate > 0.10",
    "PATCH_CHURN": "patch_attempts >= 5",
    "PREMATURE_SCRATCH_REPRO": "coalesce(nullif(first_edit_step, 0), 99) <= 1 and coalesce(search_call_count, 0) = 0",
    "EDIT_TOOL_MECHANICAL_FAILURE": "longest_tool_error_run >= 2",
    "VERIFICATION_GAP": "coalesce(targeted_test_count, 0) = 0",
    "REDUNDANT_TEST": "unchanged_repeated_tests >= 1",
    "STAGNATION": "longest_no_new_evidence_streak >= 3",
    "FAILED_RECOVERY": "patch_attempts >= 3 and targeted_test_count >= 2",
    "BUDGET_EXHAUSTION_NONCONVERGENCE": "lower(termination_reason) in ('exit_cost', 'max_steps', 'timeout', 'limitsexceeded')",
    "PREEMPTIVE_HELPER_TOOL_BUILD": "environment_setup_events >= 3",
    "HELPER_TOOL_FAILURE_LOOP": "longest_tool_error_run >= 3",
    "DEPENDENCY_SETUP_DRIFT": "environment_setup_events >= 2",
    "ENVIRONMENT_BLOCKED": "longest_tool_error_run >= 3",
}
#: Kinds that show the harness, not the model.
HARNESS = ("PREEMPTIVE_HELPER_TOOL_BUILD", "DEPENDENCY_SETUP_DRIFT", "FILENAME_SEARCH_THRASH")
# ----------------------------------------------------------------------------
#: The six ways to treat two of a block's four positions.
PATTERNS = tuple(combinations(range(4), 2))


def assignment_space(units: DataFrame) -> DataFrame:
    """Every unit (block, position from 0, unit, a) under each pattern of its block: ``arm``.

    Blocks that lack positions have the same six patterns, cut to what is there."""
    patterns = F.array(*(F.struct(F.lit(i).alias("pattern"), F.array(*(F.lit(p) for p in ones)).alias("ones")) for i, ones in enumerate(PATTERNS)))
    each = units.select("block", "position", "unit", "a", F.explode(patterns).alias("p"))
    return each.select("block", "position", "unit", "a", "p.pattern", F.array_contains("p.ones", F.col("position").cast("int")).cast("int").alias("arm"))


def design_check(units: DataFrame) -> DataFrame:
    """Of each block: its units, and whether what was assigned is one of the design's patterns."""
    fits = assignment_space(units).groupBy("block", "pattern").agg(F.bool_and(F.col("arm") == F.col("a")).alias("fits"), F.count(F.lit(1)).alias("units"))
    return fits.groupBy("block").agg(F.max("units").alias("units"), F.bool_or("fits").alias("in_space"))


def design_propensity(units: DataFrame) -> DataFrame:
    """The share of patterns that treat each unit."""
    return assignment_space(units).groupBy("block", "unit").agg(F.avg("arm").alias("propensity"))


def interaction_null(units: DataFrame, moderator: str, draws: int, seed: int = 0) -> DataFrame:
    """Randomisation p-values of the arm-by-moderator interaction under the design.

    The statistic is the interaction's least-squares coefficient beside both main effects
    and effects of blocks, and its ratio to the classical error.  A draw takes one of the
    six patterns for each block by hash; a block has at most four units, so a draw is made
    and centred inside its block's row, and only sums of products meet by draw.  The null
    is sharp: outcomes stay as they are.
    """
    s = F.col(moderator).cast("double")
    u = F.struct(F.col("position").cast("int").alias("position"), F.col("a").cast("double").alias("a"), F.col("y").cast("double").alias("y"), s.alias("s"))
    blocks = units.dropna(subset=["a", "y", moderator]).groupBy("block").agg(F.collect_list(u).alias("us"))
    drawn = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    pattern = F.floor(uniform(F.lit(seed), F.col("draw"), F.col("block")) * len(PATTERNS)).cast("int")
    ones = F.get(F.array(*(F.array(*(F.lit(p) for p in o)) for o in PATTERNS)), pattern)
    rows = drawn.select("draw", "us", ones.alias("ones"))
    arm = lambda x: F.when(F.col("draw") == 0, x["a"]).otherwise(F.array_contains(F.col("ones"), x["position"]).cast("double"))
    rows = rows.select("draw", F.transform("us", lambda x: F.struct(arm(x).alias("a"), x["s"].alias("s"), (arm(x) * x["s"]).alias("i"), x["y"].alias("y"))).alias("r"))
    names = ("a", "s", "i", "y")
    total = lambda f: F.aggregate("r", F.lit(0.0), lambda t, x: t + f(x))
    n = F.size("r")
    within = [(total(lambda x, p=p, q=q: x[p] * x[q]) - total(lambda x, p=p: x[p]) * total(lambda x, q=q: x[q]) / n).alias(f"{p}{q}") for k, p in enumerate(names) for q in names[k:]]
    m = rows.select("draw", n.alias("n"), *within).groupBy("draw").agg(*(F.sum(f"{p}{q}").alias(f"{p}{q}") for k, p in enumerate(names) for q in names[k:]), F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    c = F.col
    # The interaction, cleared of both main effects (residuals of residuals).
    clear = lambda p, q: c(p + q) - F.try_divide(c("a" + p) * c("a" + q), c("aa"))
    m = m.select("draw", "n", "blocks", clear("s", "s").alias("ss"), clear("s", "i").alias("si"), clear("s", "y").alias("sy"), clear("i", "i").alias("ii"), clear("i", "y").alias("iy"), clear("y", "y").alias("yy"))
    rest = lambda p, q, sp, sq: c(p + q) - F.try_divide(c(sp) * c(sq), c("ss"))
    m = m.select("draw", "n", "blocks", rest("i", "i", "si", "si").alias("ii"), rest("i", "y", "si", "sy").alias("iy"), rest("y", "y", "sy", "sy").alias("yy"))
    b = F.when(c("ii") > 1e-9, c("iy") / c("ii"))
    left = F.greatest(c("yy") - F.try_divide(c("iy") * c("iy"), c("ii")), F.lit(0.0))
    t = m.select("draw", b.alias("b"), F.try_divide(b, F.sqrt(F.try_divide(left, (c("n") - c("blocks") - 3) * c("ii")))).alias("t"))
    seen = t.where("draw = 0").select(c("b").alias("b0"), c("t").alias("t0"))
    both = t.where("draw > 0 and b is not null").join(F.broadcast(seen))  # a row for each draw
    p = lambda x, x0: (F.count_if(F.abs(x) >= F.abs(x0) - 1e-9) + 1) / (F.count(F.lit(1)) + 1)
    return both.agg(F.max("b0").alias("b"), F.max("t0").alias("t"), p("b", "b0").alias("p_sharp"), p("t", "t0").alias("p_studentised"), F.count(F.lit(1)).alias("draws"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """Explained share of variance and mean absolute error; the share is null without variance."""
    y, p = F.col(actual), F.col(predicted)
    rest, spread = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return df.dropna(subset=[actual, predicted]).groupBy(*by).agg((1 - F.try_divide(rest, spread)).alias("r2"), F.avg(F.abs(y - p)).alias("mae"), F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, score: str, label: Column, least: float = 1e-15) -> DataFrame:
    """AUROC, average precision, log loss and Brier score of scores in [0, 1].

    Rows are added up by distinct score first; equal scores are one step of either curve.
    Without positives or negatives what they define is null.
    """
    c = df.where(F.col(score).isNotNull() & label.isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    w = ranks.running(ranks.running(c, ["_s"], F.col("n"), "below"), ["_s"], F.col("p"), "p_below")
    total = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    w = w.join(F.broadcast(total))
    p, n, s = F.col("p"), F.col("n"), F.least(F.greatest(F.col("_s"), F.lit(least)), F.lit(1 - least))
    at_least = F.col("all_p") + F.col("all_n") - F.col("below") - F.col("p_below")
    rows = F.sum(p + n)
    return w.agg(
        F.try_divide(F.sum(p * (F.col("below") + n / 2)), F.max(F.col("all_p") * F.col("all_n"))).alias("auroc"),
        F.try_divide(F.sum(p * (F.col("all_p") - F.col("p_below")) / at_least), F.max("all_p")).alias("auprc"),
        F.try_divide(-F.sum(p * F.ln(s) + n * F.ln(1 - s)), rows).alias("log_loss"),
        F.try_divide(F.sum(p * (1 - F.col("_s")) ** 2 + n * F.col("_s") ** 2), rows).alias("brier"),
        F.coalesce(rows, F.lit(0)).alias("n"),
    )


def dose_controlled(df: DataFrame, dose: str, kind: Column, drift: str) -> DataFrame:
    """Least squares of the drift on dose and kind (0 or 1), from one pass of sums: what kind
    adds at equal dose.  Coefficients are null where dose and kind aren't apart."""
    x, k, y = F.col(dose).cast("double"), kind.cast("double"), F.col(drift).cast("double")
    g = df.select(x.alias("x"), k.alias("k"), y.alias("y")).dropna().agg(*(F.covar_pop(p, q).alias(p + q) for p, q in (("x", "x"), ("k", "k"), ("x", "k"), ("x", "y"), ("k", "y"))), F.count(F.lit(1)).alias("n"))
    c = F.col
    det = c("xx") * c("kk") - c("xk") * c("xk")
    solve = lambda top: F.when(F.abs(det) >= 1e-9, top / det)
    return g.select(solve(c("kk") * c("xy") - c("xk") * c("ky")).alias("dose"), solve(c("xx") * c("ky") - c("xk") * c("xy")).alias("kind"), "n")


def drift_ratios(pairs: DataFrame) -> DataFrame:
    """Each method's median ratios of calls and output to the baseline's."""
    r = pairs.withColumns({"call_ratio": F.col("calls") / F.greatest(F.col("base_calls"), F.lit(1)), "out_ratio": F.col("output") / F.greatest(F.col("base_output"), F.lit(1))})
    measured = ranks.with_quantiles(r, r.groupBy("method").agg(F.count(F.lit(1)).alias("n")), ["method"], "call_ratio", call_ratio=0.5)
    return ranks.with_quantiles(r, measured, ["method"], "out_ratio", out_ratio=0.5)


def verdicts(estimates: DataFrame) -> DataFrame:
    """Nine typed verdicts from one row of estimates.

    The row: prefix_ok, noop_ok, in_space (boolean), infra (count), ate_low, ate_high,
    b3_low, b3_high, p_sharp, rework_n, creation_diff, risk_low, margin, signal, keep,
    always (values of policies; less is better).  A missing estimate supports nothing.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    favours = F.when(yes(c("ate_high") < 0), "ESTABLISHED").when(yes((c("ate_low") + c("ate_high")) < 0), "DIRECTIONAL").otherwise("NOT_ESTABLISHED")
    moderates = yes((c("b3_high") < 0) & (c("p_sharp") <= 0.05))
    beats = yes((c("signal") < c("keep")) & (c("signal") < c("always")))
    state = lambda x: F.when(x, "SUPPORTED").otherwise("NOT_SUPPORTED")
    rows = {
        "PROTOCOL_INTEGRITY": state(yes(c("prefix_ok") & c("noop_ok") & c("in_space") & (c("infra") == 0))),
        "AVERAGE_EFFECT": favours,
        "MODERATOR": F.when(moderates, "ESTABLISHED").otherwise("NOT_ESTABLISHED"),
        "REWORK_SAFETY": F.when(yes(c("rework_n") > 0), "UNDERPOWERED").otherwise("NOT_ESTIMABLE"),
        "PREFIX_PRESERVATION": state(yes(c("prefix_ok"))),
        "CACHE_COST": F.when(yes(c("creation_diff") < 0), "DIRECTIONAL").otherwise("NOT_SUPPORTED"),
        "NON_INFERIORITY": F.when(yes(c("risk_low") >= c("margin")), "MET").otherwise("NOT_MET"),
        "SIGNAL_POLICY": state(beats),
        "DEPLOYABLE": state(moderates & beats & yes(c("risk_low") >= c("margin"))),
    }
    return estimates.select(F.explode(F.array(*(F.struct(F.lit(k).alias("claim"), v.alias("verdict")) for k, v in rows.items()))).alias("v")).select("v.*")


def opportunity(features: DataFrame, solver: str, strong: tuple[str, ...], weak: tuple[str, ...], proxies: dict[str, str] = PROXIES) -> DataFrame:
    """Prevalence of each kind of waste: over all, strong and weak solvers, with score and tier.

    Predicates are counted in one aggregate by solver; a missing feature is no sign.
    """
    by = features.groupBy(F.col(solver).alias("solver")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(p)).alias(f"k_{k}") for k, p in proxies.items()))
    long = by.select("solver", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("k")) for k in proxies))).alias("p")).select("solver", "n", "p.*")
    share = lambda of: F.coalesce(F.sum(F.when(F.col("solver").isin(*of), 100 * F.col("k") / F.col("n"))), F.lit(0.0)) / len(of)
    o = long.groupBy("kind").agg((100 * F.sum("k") / F.sum("n")).alias("prevalence"), share(strong).alias("strong"), share(weak).alias("weak")).withColumn("gap", F.col("weak") - F.col("strong"))
    points = F.when(F.col("prevalence") >= 40, 2).when(F.col("prevalence") >= 15, 1).otherwise(0) + F.when(F.col("gap") >= 20, 2).when(F.col("gap") >= 5, 1).when(F.col("gap") <= -20, -1).otherwise(0)
    o = o.withColumn("score", points - F.when(F.col("kind").isin(*HARNESS), 2).otherwise(0))
    return o.withColumn("tier", F.when(F.col("score") >= 4, "HIGH").when(F.col("score") >= 2, "MEDIUM").otherwise("LOW"))


def prevalence_above(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Share of rows above a threshold for each column, of those that have a value."""
    one = df.agg(*(F.avg((F.col(c) > threshold).cast("double")).alias(f"s_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("share"), F.col(f"n_{c}").alias("n")) for c in columns))).alias("r")).select("r.*")


def success_contrast(runs: DataFrame) -> DataFrame:
    """Success rates over repetitions by task, and what treatment adds to them; tasks that lack
    an arm have no contrast.  ``flips``: whether repetitions of the untreated arm disagree."""
    rate = lambda k: F.avg(F.when(F.col("a") == k, F.col("passed").cast("double")))
    r = runs.groupBy("task").agg(rate(1).alias("treated"), rate(0).alias("untreated"))
    return r.withColumns({"effect": F.col("treated") - F.col("untreated"), "flips": (F.col("untreated") > 0) & (F.col("untreated") < 1)})


def merge_evidenced(votes: DataFrame) -> DataFrame:
    """Votes (unit, rater, primary, labels: array of (label, evidence)) to one row a unit: its
    labels that any rater gave evidence for with the raters that did, all their evidence,
    and the primary label most raters chose (of equals, the first rater's)."""
    l = votes.select("unit", "rater", F.explode("labels").alias("l")).select("unit", "rater", "l.label", "l.evidence").where(F.size("evidence") > 0)
    e = l.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("support"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))  # a unit has few raters
    e = e.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("label", "support", "evidence"))).alias("labels"))
    c = votes.where(F.col("primary").isNotNull()).groupBy("unit", "primary").agg(F.count(F.lit(1)).alias("n"), F.min("rater").alias("first"))
    top = c.groupBy("unit").agg(F.min(F.struct(-F.col("n"), "first", "primary"))["primary"].alias("primary"))
    return votes.select("unit").distinct().join(top, "unit", "left").join(e, "unit", "left").withColumn("labels", F.coalesce("labels", F.array().cast(e.schema["labels"].dataType)))


def detector_precision(flags: DataFrame, traces: int = 60, audited: int = 25) -> DataFrame:
    """Flags (feature, trace_id, signal, flagged, confirmed) of each feature's first ``audited``
    traces with a flag among its ``traces`` strongest: what was flagged and what held."""
    w = Window.partitionBy("feature")
    top = flags.withColumn("r", F.row_number().over(w.orderBy(F.desc("signal"), "trace_id"))).where(F.col("r") <= traces)  # the rank filter is pushed below the shuffle
    seen = top.where("flagged > 0").withColumn("k", F.row_number().over(w.orderBy("r"))).where(F.col("k") <= audited)
    return seen.groupBy("feature").agg(F.count(F.lit(1)).alias("traces"), F.sum("flagged").alias("flagged"), F.sum("confirmed").alias("confirmed"), F.try_divide(F.sum("confirmed"), F.sum("flagged")).alias("precision"))


def falsification(pairs: DataFrame, feature: str, cluster: str, unit: str, draws: int) -> DataFrame:
    """What an arm that changes nothing seems to save: its mean saving, how a feature ranks
    with it, and the interval of the total saving when clusters are drawn again.

    Far from zero, any of them says that the feature predicts noise."""
    mean = pairs.agg(F.avg("saving").alias("mean_saving"), F.try_divide(100 * (F.sum("base") - F.sum("cost")), F.sum("base")).alias("total_saving"))
    rank = spearman(pairs, "saving", feature, unit).select("rho", "n")
    ci = bootstrap(pairs, cluster, {"b": F.sum("base"), "c": F.sum("cost")}, F.try_divide(100 * (F.col("b") - F.col("c")), F.col("b")), draws)
    return mean.join(F.broadcast(rank)).join(F.broadcast(ci))  # one row each
