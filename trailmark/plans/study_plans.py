"""Queries on blocked designs, models, dose, verdicts and opportunity, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import experiments, ledger, sequence, statistics, studies
from ..sources import tables
from .catalog import E, G, L, V, query

_PATTERNS = "[" + ", ".join(str(list(p)) for p in experiments.PATTERNS) + "]"
_UNITS = f"""WITH u AS (SELECT d.doc_id AS unit, d.doc_id // 4 AS block, d.doc_id % 4 AS position, n_chars::DOUBLE AS y, (d.doc_id % 97) / 97.0 AS moderator,
 list_contains({_PATTERNS}[(d.doc_id // 4) % 6 + 1], (d.doc_id % 4)::INT)::INT AS drawn, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id))"""


def _units(spark, d, flips: bool = False):
    docs = tables.read(spark, d, "documents").join(tables.read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    block = F.floor(F.col("doc_id") / 4).cast("long")
    ones = F.get(F.array(*(F.array(*(F.lit(p) for p in o)) for o in experiments.PATTERNS)), (block % 6).cast("int"))
    a = F.array_contains(ones, (F.col("doc_id") % 4).cast("int")).cast("int")
    a = F.when(F.coalesce("toxic", F.lit(0)) == 1, 1 - a).otherwise(a) if flips else a
    return docs.select(F.col("doc_id").alias("unit"), block.alias("block"), (F.col("doc_id") % 4).alias("position"), a.alias("a"), F.col("n_chars").cast("double").alias("y"), (F.col("doc_id") % 97 / 97.0).alias("moderator"))


@query("design_check", _UNITS + f""", p AS (SELECT i - 1 AS pattern, {_PATTERNS}[i] AS ones FROM (SELECT unnest(range(1, 7)) AS i)), f AS (SELECT block, pattern, bool_and(list_contains(ones, position::INT)::INT = CASE WHEN toxic = 1 THEN 1 - drawn ELSE drawn END) AS fits, count(*) AS n FROM u, p GROUP BY 1, 2)
SELECT block, max(n)::BIGINT AS units, bool_or(fits) AS in_space FROM f GROUP BY 1""")
def _(spark, d):
    """Blocks whose assignment is one of the six patterns of two in four."""
    return experiments.design_check(_units(spark, d, True))


@query("design_propensity", _UNITS + "SELECT block, unit, 0.5::DOUBLE AS propensity FROM u")
def _(spark, d):
    """The design's share of treatment of each unit, incomplete blocks too."""
    return experiments.design_propensity(_units(spark, d))


_SUMS = ", ".join(f"sum({p} * {q}) AS {p}{q}" for k, p in enumerate("asiy") for q in "asiy"[k:])


@query("interaction_null", _UNITS + f""", d AS (SELECT block, moderator AS s, y, draw, CASE WHEN draw = 0 THEN drawn ELSE list_contains({_PATTERNS}[floor(('0x' || substr(sha256('0|' || draw || '|' || block), 1, 8))::BIGINT / 4294967296.0 * 6)::INT + 1], position::INT)::INT END AS a FROM u, (SELECT unnest(range(61)) AS draw)),
 c AS (SELECT draw, block, a - avg(a) OVER w AS a, s - avg(s) OVER w AS s, a * s - avg(a * s) OVER w AS i, y - avg(y) OVER w AS y FROM d WINDOW w AS (PARTITION BY draw, block)),
 m AS (SELECT draw, count(*) AS n, count(DISTINCT block) AS blocks, {_SUMS} FROM c GROUP BY 1),
 q AS (SELECT *, aa * (ss * ii - si * si) - "as" * ("as" * ii - si * ai) + ai * ("as" * si - ss * ai) AS det FROM m),
 b AS (SELECT *, (ay * (ss * ii - si * si) - "as" * (sy * ii - si * iy) + ai * (sy * si - ss * iy)) / det AS b1, (aa * (sy * ii - si * iy) - ay * ("as" * ii - si * ai) + ai * ("as" * iy - sy * ai)) / det AS b2,
  (aa * (ss * iy - sy * si) - "as" * ("as" * iy - sy * ai) + ay * ("as" * si - ss * ai)) / det AS b3 FROM q),
 t AS (SELECT draw, b3, b3 / sqrt((yy - b1 * ay - b2 * sy - b3 * iy) / (n - blocks - 3) / (det / (aa * ss - "as" * "as"))) AS t FROM b),
 z AS (SELECT *, max(b3) FILTER (draw = 0) OVER () AS b0, max(t) FILTER (draw = 0) OVER () AS t0 FROM t)
SELECT round(max(b0), 4) AS b, round(max(t0), 4) AS t, round((count(*) FILTER (abs(b3) >= abs(b0) - 1e-9) + 1) / (count(*) + 1), 4) AS p_sharp, round((count(*) FILTER (abs(t) >= abs(t0) - 1e-9) + 1) / (count(*) + 1), 4) AS p_studentised, count(*)::BIGINT AS draws FROM z WHERE draw > 0""")
def _(spark, d):
    """Sharp-null and studentised p-values of an interaction beside block effects."""
    return experiments.interaction_null(_units(spark, d), "moderator", 60)


@query("score_metrics", G + """, x AS (SELECT moderator AS s, count(*) FILTER (a = 1) AS p, count(*) FILTER (a = 0) AS n FROM g GROUP BY 1),
 z AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS k, sum(p) OVER () AS ap, sum(n) OVER () AS an, least(greatest(s, 1e-15), 1 - 1e-15) AS c FROM x)
SELECT round(sum(p * (an - (k - tp) + n / 2)) / max(ap * an), 4) AS auroc, round(sum(p * tp / k) / max(ap), 4) AS auprc, round(-sum(p * ln(c) + n * ln(1 - c)) / sum(p + n), 4) AS log_loss, round(sum(p * (1 - s) ** 2 + n * s ** 2) / sum(p + n), 4) AS brier, sum(p + n)::BIGINT AS n FROM z""")
def _(spark, d):
    """AUROC, average precision, log loss and Brier score."""
    return experiments.class_metrics(tables.trial(spark, d), "moderator", F.col("a") == 1)


@query("cv_one_feature", G + """, k AS (SELECT f.fold, regr_slope(y, moderator) AS b, regr_intercept(y, moderator) AS c FROM g, (SELECT unnest(range(5)) AS fold) f WHERE task_id % 5 <> f.fold GROUP BY 1), p AS (SELECT fold, y, c + b * moderator AS p FROM g JOIN k ON task_id % 5 = fold)
SELECT fold, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def _(spark, d):
    """Out-of-fold share of variance and absolute error of a model of one feature."""
    t = tables.trial(spark, d).withColumn("fold", F.col("unit") % 5)
    return experiments.regression_metrics(studies.out_of_fold_ridge(t, "fold", "unit", "y", ["moderator"], 0.0), "y", "predicted", "fold")


@query("cv_ablation")
def _(spark, d):
    """Means over folds for nested sets of features (numpy solves; rows only)."""
    t = tables.trial(spark, d).withColumns({"fold": F.col("unit") % 5, "s": (F.col("stratum") == "HIGH").cast("double")})
    sets = {"A": ["moderator"], "B": ["moderator", "s"], "C": ["moderator", "s", "a"]}
    out = None
    for name, x in sets.items():
        m = experiments.regression_metrics(studies.out_of_fold_ridge(t, "fold", "unit", "y", x, 0.0), "y", "predicted", "fold").agg(F.lit(name).alias("features"), F.avg("r2").alias("r2"), F.avg("mae").alias("mae"))
        out = m if out is None else out.unionByName(m)
    return out


_DRIFT = L + """, o AS (SELECT task_id, method, count(*) AS calls, sum(output_tokens) AS output, sum(CASE WHEN changed THEN chars_removed ELSE 0 END) AS removed FROM l GROUP BY 1, 2),
 r AS (SELECT o.*, b.calls AS base_calls, b.output AS base_output FROM o JOIN o b ON b.task_id = o.task_id AND b.method = 'N' WHERE o.method <> 'N')"""


def _drift(spark, d):
    removed = F.sum(F.when(F.col("changed"), F.col("chars_removed")).otherwise(0))
    o = tables.ledger(spark, d).repartition("task_id").groupBy("task_id", "method").agg(F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output"), removed.alias("removed"))
    base = lambda c: F.max(F.when(F.col("method") == tables.BASELINE, F.col(c))).over(Window.partitionBy("task_id"))
    return o.withColumns({"base_calls": base("calls"), "base_output": base("output")}).where(F.col("base_calls").isNotNull() & (F.col("method") != tables.BASELINE))


@query("dose_controlled", _DRIFT + """, c AS (SELECT removed / 1000 AS x, (method = 'R')::INT AS k, calls / base_calls AS y FROM r WHERE removed > 0), v AS (SELECT covar_pop(x, x) AS xx, covar_pop(k, k) AS kk, covar_pop(x, k) AS xk, covar_pop(x, y) AS xy, covar_pop(k, y) AS ky, count(*) AS n FROM c)
SELECT round((kk * xy - xk * ky) / (xx * kk - xk * xk), 4) AS dose, round((xx * ky - xk * xy) / (xx * kk - xk * xk), 4) AS kind, n::BIGINT AS n FROM v""")
def _(spark, d):
    """Drift of calls by dose and kind of removal together."""
    r = _drift(spark, d).where("removed > 0").select((F.col("removed") / 1000).alias("dose"), "method", (F.col("calls") / F.col("base_calls")).alias("drift"))
    return experiments.dose_controlled(r, "dose", F.col("method") == "R", "drift")


@query("drift_ratios", _DRIFT + "SELECT method, count(*)::BIGINT AS n, round(median(calls / base_calls), 4) AS call_ratio, round(median(output / greatest(base_output, 1)), 4) AS out_ratio FROM r GROUP BY 1")
def _(spark, d):
    """Median ratios of calls and output to the baseline's."""
    return experiments.drift_ratios(_drift(spark, d))


_BOOT = """i AS (SELECT *, row_number() OVER (ORDER BY c NULLS FIRST) - 1 AS idx, count(*) OVER () AS k FROM c),
 d AS (SELECT r.draw, floor(('0x' || substr(sha256('0|' || r.draw || '|' || i.idx), 1, 8))::BIGINT / 4294967296.0 * i.k)::BIGINT AS pick FROM i, (SELECT unnest(range(100)) AS draw) r)"""


@query("sham_falsification", L + ", s AS (SELECT p.*, task_id % 40 AS c, (task_id % 89) / 89.0 AS feature FROM p WHERE method = 'R'), c AS (SELECT c, sum(base) AS b, sum(cost) AS v FROM s GROUP BY 1), " + _BOOT + """, w AS (SELECT draw, 100 * (sum(b) - sum(v)) / sum(b) AS t FROM d JOIN i ON pick = idx GROUP BY 1),
 k AS (SELECT row_number() OVER (ORDER BY saving, task_id) AS rx, row_number() OVER (ORDER BY feature, task_id) AS ry FROM s)
SELECT (SELECT round(avg(saving), 4) FROM s) AS mean_saving, (SELECT round(100 * (sum(base) - sum(cost)) / sum(base), 4) FROM s) AS total_saving, (SELECT round(1 - 6 * sum((rx - ry)::DOUBLE * (rx - ry)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 4) FROM k) AS rho, (SELECT count(*)::BIGINT FROM k) AS n,
 round(quantile_cont(t, 0.025), 4) AS low, round(quantile_cont(t, 0.975), 4) AS high, count(*)::BIGINT AS draws FROM w""")
def _(spark, d):
    """Does a feature rank with the saving of an arm, and does the saving outlast drawing clusters again?"""
    pairs = ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE).where("method = 'R'")
    return experiments.falsification(pairs.withColumns({"c": F.col("task_id") % 40, "feature": F.col("task_id") % 89 / 89.0}), "feature", "c", "task_id", 100)


@query("policy_difference", G + ", h AS (SELECT *, (stratum = 'HIGH')::INT AS arm FROM g), c AS (SELECT cluster AS c, sum(y) FILTER (a = arm) AS ys, count(*) FILTER (a = arm) AS ws, sum(y) FILTER (a = 1) AS y1, count(*) FILTER (a = 1) AS w1 FROM h GROUP BY 1), " + _BOOT + """, w AS (SELECT draw, sum(ys) / sum(ws) - sum(y1) / sum(w1) AS t FROM d JOIN i ON pick = idx GROUP BY 1 HAVING sum(ws) > 0 AND sum(w1) > 0)
SELECT round(quantile_cont(t, 0.025), 4) AS low, round(quantile_cont(t, 0.975), 4) AS high, count(*)::BIGINT AS draws FROM w""")
def _(spark, d):
    """Interval of the difference in value of two policies, clusters drawn again."""
    t = tables.trial(spark, d)
    on = lambda arm: F.when(F.col("a") == arm, F.col("y"))
    signal = F.when(F.col("stratum") == "HIGH", 1).otherwise(0)
    sums = {"ys": F.sum(on(signal)), "ws": F.count(on(signal)), "y1": F.sum(on(F.lit(1))), "w1": F.count(on(F.lit(1)))}
    return statistics.bootstrap(t, "cluster", sums, F.try_divide("ys", "ws") - F.try_divide("y1", "w1"), 100)


@query("verdict_rows")
def _(spark, d):
    """Nine verdicts of a whole analysis (rules are tested on cases; rows only)."""
    t = tables.trial(spark, d)
    u = _units(spark, d)
    ate = statistics.cluster_bootstrap(t, 100).select(F.col("low").alias("ate_low"), F.col("high").alias("ate_high"))
    null = experiments.interaction_null(u, "moderator", 60).select((F.col("b") - 1.96 * F.abs(F.col("b") / F.col("t"))).alias("b3_low"), (F.col("b") + 1.96 * F.abs(F.col("b") / F.col("t"))).alias("b3_high"), "p_sharp")
    space = experiments.design_check(u).agg(F.bool_and("in_space").alias("in_space"))
    risk = statistics.newcombe(t, F.col("y") < 2000, -0.15).select(F.col("low").alias("risk_low"))
    arms = {"keep": F.lit(0), "always": F.lit(1), "signal": F.when(F.col("stratum") == "HIGH", 1).otherwise(0)}
    value = statistics.hajek(t, arms).agg(*(F.max(F.when(F.col("policy") == p, F.col("hajek"))).alias(p) for p in arms))
    creation = ledger.mechanism(tables.ledger(spark, d), "changed").where("component = 'cache_creation_tokens'").select(F.col("diff").alias("creation_diff"))
    row = ate
    for more in (null, space, risk, value, creation):
        row = row.join(F.broadcast(more), how="left")  # one row each
    flags = {"prefix_ok": F.lit(True), "noop_ok": F.lit(True), "infra": F.lit(0), "rework_n": F.lit(0), "margin": F.lit(-0.15)}
    return experiments.verdicts(row.withColumns(flags))


_FEATURES = {
    "duplicate_file_reads": "o_orderkey % 4", "unique_files_searched": "o_custkey % 13", "exact_duplicate_call_rate": "(o_orderkey % 7) / 20.0", "patch_attempts": "o_orderkey % 6", "first_edit_step": "o_orderkey % 5",
    "search_call_count": "o_custkey % 2", "longest_tool_error_run": "o_custkey % 5", "targeted_test_count": "o_orderkey % 3", "unchanged_repeated_tests": "CASE WHEN o_custkey % 2 = 0 THEN 1 END",
    "longest_no_new_evidence_streak": "o_custkey % 6", "termination_reason": "CASE WHEN o_orderkey % 10 = 0 THEN 'TIMEOUT' END", "environment_setup_events": "o_custkey % 4",
}
_SHARE = lambda s: f"coalesce(100.0 * count(*) FILTER (hit AND solver = '{s}') / nullif(count(*) FILTER (solver = '{s}'), 0), 0)"


@query("opportunity", "WITH f AS (SELECT o_orderstatus AS solver, " + ", ".join(f"{v} AS {k}" for k, v in _FEATURES.items()) + " FROM orders), h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, solver, coalesce({p}, false) AS hit FROM f" for k, p in experiments.PROXIES.items()) + f"), o AS (SELECT kind, 100.0 * count(*) FILTER (hit) / count(*) AS prevalence, {_SHARE('F')} AS strong, {_SHARE('O')} AS weak FROM h GROUP BY 1)," + """
 s AS (SELECT *, weak - strong AS gap, CASE WHEN prevalence >= 40 THEN 2 WHEN prevalence >= 15 THEN 1 ELSE 0 END + CASE WHEN weak - strong >= 20 THEN 2 WHEN weak - strong >= 5 THEN 1 WHEN weak - strong <= -20 THEN -1 ELSE 0 END - CASE WHEN kind IN """ + str(experiments.HARNESS) + """ THEN 2 ELSE 0 END AS score FROM o)
SELECT kind, round(prevalence, 4) AS prevalence, round(strong, 4) AS strong, round(weak, 4) AS weak, round(gap, 4) AS gap, score::BIGINT AS score, CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s""")
def _(spark, d):
    """Prevalence, gap, score and tier of sixteen kinds of waste."""
    f = tables.read(spark, d, "orders").select(F.col("o_orderstatus").alias("solver"), *(F.expr(v).alias(k) for k, v in _FEATURES.items()))
    return experiments.opportunity(f, "solver", ("F",), ("O",))


@query("prevalence_above", "WITH x AS (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS quantity, l_discount * 500 AS discount FROM lineitem) SELECT 'quantity' AS feature, round(avg((quantity > 20)::INT), 4) AS share, count(quantity)::BIGINT AS n FROM x UNION ALL SELECT 'discount', round(avg((discount > 20)::INT), 4), count(discount)::BIGINT FROM x")
def _(spark, d):
    """A10: share above a threshold among the rows that have a value."""
    x = tables.read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("quantity"), (F.col("l_discount") * 500).alias("discount"))
    return experiments.prevalence_above(x, ["quantity", "discount"], 20)


@query("success_contrast", "WITH r AS (SELECT o_custkey AS task, avg((o_totalprice < 150000)::INT) FILTER (o_orderkey % 2 = 1) AS t, avg((o_totalprice < 150000)::INT) FILTER (o_orderkey % 2 = 0) AS u FROM orders GROUP BY 1) SELECT task, round(t, 4) AS treated, round(u, 4) AS untreated, round(t - u, 4) AS effect, u > 0 AND u < 1 AS flips FROM r")
def _(spark, d):
    """Success over repetitions by task and arm, their contrast, and unstable tasks."""
    return experiments.success_contrast(tables.read(spark, d, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 2).alias("a"), (F.col("o_totalprice") < 150000).alias("passed")))


@query("merge_evidenced", V.replace(" AS labels FROM d1)", " AS labels, digit FROM d1)") + """, l AS (SELECT unit, rater, unnest(labels) AS label, CASE WHEN digit % 3 <> 0 THEN [digit, digit + 1] ELSE [] END AS evidence FROM v), e AS (SELECT unit, label, count(*) AS support, array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence FROM l WHERE len(evidence) > 0 GROUP BY 1, 2),
 j AS (SELECT unit, string_agg(label || ':' || support || ':' || evidence, ';' ORDER BY label) AS labels FROM e GROUP BY 1), c AS (SELECT unit, label, count(*) AS n, min(rater) AS f FROM v WHERE label IS NOT NULL GROUP BY 1, 2), t AS (SELECT unit, label FROM c QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, f) = 1)
SELECT u.unit, t.label AS "primary", coalesce(j.labels, '') AS labels FROM (SELECT DISTINCT unit FROM v) u LEFT JOIN t USING (unit) LEFT JOIN j USING (unit)""")
def _(spark, d):
    """Labels with evidence, their support, and the majority's primary label."""
    v = tables.votes(spark, d)
    evidence = F.when(F.col("digit") % 3 != 0, F.array("digit", F.col("digit") + 1)).otherwise(F.array().cast("array<int>"))
    m = experiments.merge_evidenced(v.select("unit", "rater", F.col("label").alias("primary"), F.transform("labels", lambda x: F.struct(x.alias("label"), evidence.alias("evidence"))).alias("labels")))
    text = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["label"], x["support"].cast("string"), F.array_join(F.transform(x["evidence"], lambda i: i.cast("string")), ","))), ";")
    return m.select("unit", "primary", text.alias("labels"))


@query("detector_precision", "WITH f AS (SELECT l_returnflag AS feature, l_orderkey AS trace_id, sum(l_quantity) AS signal, count(*) FILTER (l_discount > 0.05) AS flagged, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.03) AS confirmed FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY signal DESC, trace_id) AS r FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY r) AS k FROM r WHERE r <= 60 AND flagged > 0) SELECT feature, count(*)::BIGINT AS traces, sum(flagged)::BIGINT AS flagged, sum(confirmed)::BIGINT AS confirmed, round(sum(confirmed) / sum(flagged), 4) AS precision FROM k WHERE k <= 25 GROUP BY 1")
def _(spark, d):
    """What holds of each detector's flags in its strongest traces."""
    flag = F.col("l_discount") > 0.05
    f = tables.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature"), F.col("l_orderkey").alias("trace_id")).agg(F.sum("l_quantity").alias("signal"), F.count_if(flag).alias("flagged"), F.count_if(flag & (F.col("l_tax") > 0.03)).alias("confirmed"))
    return experiments.detector_precision(f)


@query("stagnation", E + """, h AS (SELECT trace_id, event_index, output_hash, unnest(regexp_extract_all(target, '[0-9]+')) AS f FROM e), n AS (SELECT DISTINCT trace_id, event_index FROM (SELECT trace_id, f, min(event_index) AS event_index FROM h GROUP BY 1, 2)),
 s AS (SELECT e.trace_id, e.event_index, row_number() OVER (PARTITION BY e.trace_id, output_hash ORDER BY e.event_index) > 1 AND n.trace_id IS NULL AS stale FROM e LEFT JOIN n ON n.trace_id = e.trace_id AND n.event_index = e.event_index),
 r AS (SELECT *, count(*) FILTER (NOT stale) OVER (PARTITION BY trace_id ORDER BY event_index) AS run FROM s), q AS (SELECT trace_id, run, count(*) FILTER (stale) AS stale, count(*) AS n FROM r GROUP BY 1, 2) SELECT trace_id, max(stale)::BIGINT AS longest, round(sum(stale) / sum(n), 4) AS fraction FROM q GROUP BY 1""")
def _(spark, d):
    """Longest run without a new result or file, and the share of such rows."""
    e = tables.events(spark, d).withColumn("files", F.regexp_extract_all("target", F.lit("([0-9]+)")))
    return sequence.stagnation(e, "trace_id", "event_index", "output_hash", "files")
