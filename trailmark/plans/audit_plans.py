"""Queries on samples, splits, audits, verdicts and estimators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, audits, ledger, statistics
from ..sources import tables
from .catalog import SQL, G, L, V, query

_H = "sha256({0}::VARCHAR)"
_SPLIT = """WITH u AS (SELECT doc_id, source, lang FROM documents), g AS (SELECT DISTINCT source FROM u WHERE source IS NOT NULL),
r AS (SELECT source, row_number() OVER (ORDER BY sha256(source), source) - 1 AS r, (SELECT count(*) FROM g) AS n FROM g),
q AS (SELECT source, CASE WHEN r < greatest(1, n // 5) THEN 'test' WHEN r >= n // 5 AND r < n // 5 + greatest(1, n // 10) THEN 'validation' ELSE 'train' END AS part FROM r),
s AS (SELECT doc_id, u.source, lang, CASE WHEN lang = 'de' THEN 'model_transfer_test' ELSE coalesce(part, 'train') END AS part FROM u LEFT JOIN q ON u.source = q.source)"""


def _split(spark, d):
    return audits.split_by_group(tables.read(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang", "de")


@query("repo_disjoint_split", _SPLIT + "SELECT doc_id AS trace, part FROM s")
def _(spark, d):
    """Groups to test, validation and train, and a held-out solver."""
    return _split(spark, d).select(F.col("doc_id").alias("trace"), "part")


@query("split_audit", """WITH s AS (SELECT l_orderkey AS trace, l_partkey AS task, l_orderkey // 2 AS base, l_returnflag AS solver, l_suppkey AS repo,
 CASE WHEN l_linenumber = 7 THEN 'repo_transfer_test' WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'validation' ELSE 'test' END AS part FROM lineitem)
SELECT 'trace_overlap' AS audit, (SELECT count(*) FROM (SELECT trace FROM s WHERE part <> 'repo_transfer_test' GROUP BY 1 HAVING count(DISTINCT part) > 1))::BIGINT AS violations
UNION ALL SELECT 'task_overlap', (SELECT count(*) FROM (SELECT task FROM s GROUP BY 1 HAVING bool_or(part = 'train') AND bool_or(part = 'test')))
UNION ALL SELECT 'base_overlap', (SELECT count(*) FROM (SELECT base FROM s GROUP BY 1 HAVING bool_or(part = 'train') AND bool_or(part IN ('test', 'validation'))))
UNION ALL SELECT 'held_out_in_train', (SELECT count(*) FROM s WHERE part = 'train' AND solver = 'R')
UNION ALL SELECT 'repo_transfer_overlap', (SELECT count(*) FROM (SELECT repo FROM s GROUP BY 1 HAVING bool_or(part = 'train') AND bool_or(part = 'repo_transfer_test')))""")
def _(spark, d):
    """The five leaks of a split by order."""
    k = F.col("l_orderkey") % 10
    part = F.when(F.col("l_linenumber") == 7, "repo_transfer_test").when(k < 7, "train").when(k < 9, "validation").otherwise("test")
    s = tables.read(spark, d, "lineitem").select(part.alias("part"), F.col("l_orderkey").alias("trace"), F.col("l_partkey").alias("task"), F.floor(F.col("l_orderkey") / 2).alias("base"), F.col("l_returnflag").alias("solver"), F.col("l_suppkey").alias("repo"))
    return audits.split_audit(s, "R")


@query("audit_sample", """WITH u AS (SELECT o_orderkey AS unit, o_orderpriority AS cell, o_orderstatus AS axis, sha256(o_orderkey::VARCHAR) AS h FROM orders),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY h, unit) = 1 THEN 1 END AS t FROM u),
b AS (SELECT *, coalesce(t, CASE WHEN row_number() OVER (PARTITION BY axis, t IS NULL ORDER BY h, unit) <= 20 THEN 2 END, 3) AS taken FROM a)
SELECT unit, cell, axis, taken::BIGINT AS taken FROM b ORDER BY taken, h, unit LIMIT 120""")
def _(spark, d):
    """Three passes of a stratified audit sample of 120."""
    u = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("axis"))
    return audits.audit_sample(u, "unit", "cell", "axis", 20, 120)


@query("task_pools", """WITH u AS (SELECT DISTINCT o_custkey AS unit, sha256(o_custkey::VARCHAR) AS h FROM orders), r AS (SELECT unit, row_number() OVER (ORDER BY h, unit) AS n FROM u)
SELECT unit, CASE WHEN n <= 80 THEN 'calibration' ELSE 'evaluation' END AS pool FROM r WHERE n <= 160""")
def _(spark, d):
    """Two disjoint pools of 80 units."""
    return audits.pools(tables.read(spark, d, "orders").select(F.col("o_custkey").alias("unit")), "unit", 80)


@query("index_tertiles", """WITH r AS (SELECT c_mktsegment AS grp, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT grp, round(max(CASE WHEN k = n // 3 + 1 THEN c_acctbal END), 4) AS low, round(max(CASE WHEN k = 2 * n // 3 + 1 THEN c_acctbal END), 4) AS high FROM r GROUP BY 1""")
def _(spark, d):
    """The values at n // 3 and 2n // 3 of each group's sorted values."""
    return ledger.index_tertiles(tables.read(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumnRenamed("c_mktsegment", "grp")


@query("source_catalogue", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def _(spark, d):
    """S3: units of allowed status, 25 of each source at most (the limit is what is asked for)."""
    u = tables.read(spark, d, "documents").select("doc_id", "source", "lang")
    return audits.catalogue(u, "source", "doc_id", F.col("lang").isin("en", "fr"), 25).select("doc_id", "source")


@query("paired_votes", V + """, a AS (SELECT unit, label, len(labels) AS n FROM v WHERE rater = 'r1' AND unit % 3 <> 0), b AS (SELECT unit, label, len(labels) AS n FROM v WHERE rater = 'r2' AND unit % 5 <> 0)
SELECT coalesce(a.unit, b.unit) AS unit, a.label AS label_1, a.n::BIGINT AS n_1, b.label AS label_2, b.n::BIGINT AS n_2 FROM a FULL JOIN b ON a.unit = b.unit""")
def _(spark, d):
    """Two raters' votes side by side, null where one has none."""
    v = tables.votes(spark, d).select("unit", "rater", "label", F.size("labels").alias("n"))
    return audits.pair_votes(v.where("rater = 'r1' and unit % 3 <> 0").drop("rater"), v.where("rater = 'r2' and unit % 5 <> 0").drop("rater"), "unit")


@query("index_with_grades", """SELECT doc_id AS trace, lang, CASE quality WHEN 1 THEN 'SOLVED' WHEN 0 THEN 'UNSOLVED' ELSE 'UNKNOWN' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, d):
    """The index of traces with their grades; UNKNOWN where there is none."""
    from ..operators.evidence import outcome_label

    joined = tables.read(spark, d, "documents").select("doc_id", "lang").join(tables.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select(F.col("doc_id").alias("trace"), "lang", outcome_label(F.col("quality") == 1).alias("outcome"))


@query("hash_alignment", """WITH a AS (SELECT substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT substr(sha256(coalesce(text, '')), 1, 16) AS h, true AS hit FROM documents WHERE doc_id % 2 = 1)
SELECT count(*)::BIGINT AS n, count(hit)::BIGINT AS matched, (count(*) - count(hit))::BIGINT AS unmatched FROM a LEFT JOIN b USING (h)""")
def _(spark, d):
    """Segments found again by their content hash, and those that aren't."""
    docs = tables.read(spark, d, "documents").select("doc_id", "text")
    return audits.align(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text")


@query("sealed_outcomes", """SELECT 'd' || b.doc_id AS event, l.quality::BIGINT AS outcome FROM (SELECT doc_id FROM documents WHERE n_chars >= 2000) b JOIN labels l ON 'd' || b.doc_id = 'd' || l.doc_id""")
def _(spark, d):
    """Sealed outcomes opened by a key derived from the event."""
    events = tables.read(spark, d, "documents").where("n_chars >= 2000").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("#view")).alias("view"))
    sealed = tables.read(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event"), F.col("quality").alias("outcome"))
    return events.select(F.substring_index("view", "#", 1).alias("event")).join(sealed, "event")


@query("reduction_totals", L + "SELECT method, round(100 * (sum(base) - sum(cost)) / sum(base), 4) AS bill_weighted, round(avg(saving), 4) AS task_mean, round(median(saving), 4) AS task_median FROM p GROUP BY 1")
def _(spark, d):
    """Saving weighted by bill and by task."""
    p = ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE)
    return ledger.reduction_totals(p)


@query("cache_creation_share", L + """SELECT task_id, method, round(sum(cache_creation_tokens) / sum(input_tokens + cache_read_tokens + cache_creation_tokens), 4) AS share
FROM l GROUP BY 1, 2 HAVING sum(input_tokens + cache_read_tokens + cache_creation_tokens) > 1000""")
def _(spark, d):
    """Cache creation's share of each task's prompt, where that is over 1000 tokens."""
    return ledger.creation_share(tables.ledger(spark, d), 1000)


_DOSE = L + """, x AS (SELECT p.method, p.saving, CASE WHEN t.chars_removed < 100 THEN 0 WHEN t.chars_removed < 1000 THEN 1 WHEN t.chars_removed < 10000 THEN 2 ELSE 3 END AS bin FROM p JOIN t ON p.task_id = t.task_id AND p.method = t.method)"""


@query("dose_bins", _DOSE + "SELECT bin::BIGINT AS bin, method, count(*)::BIGINT AS n, round(median(saving), 4) AS median_saving, round(avg(saving), 4) AS mean_saving FROM x GROUP BY 1, 2")
def _(spark, d):
    """Savings by half-open bins of what was removed."""
    c = ledger.task_cost(tables.with_cost(tables.ledger(spark, d)))
    return ledger.dose_bins(ledger.paired(c, tables.BASELINE, "chars_removed"), "chars_removed", (100, 1000, 10000))


@query("flip_rate", """WITH u AS (SELECT o_custkey, count(DISTINCT o_orderstatus = 'F') AS k, count(*) AS n, stddev_samp(o_totalprice) / avg(o_totalprice) AS cv FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT count(*)::BIGINT AS units, count(*) FILTER (k > 1)::BIGINT AS unstable, round(count(*) FILTER (k > 1) / count(*), 4) AS flip_rate, round(avg(cv), 4) AS mean_cv FROM u""")
def _(spark, d):
    """Units whose repeated outcomes differ, and how much their costs vary."""
    return audits.flips(tables.read(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice")


_METHODS = L + """, s AS (SELECT method, 100 * (sum(base) - sum(cost)) / sum(base) AS saving, count(*) FILTER (saving < -500) AS k, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT *, least(1.0, (k / n + 1.645 * 1.645 / 2 / n + 1.645 * sqrt(k / n * (1 - k / n) / n + 1.645 * 1.645 / 4 / (n * n))) / (1 + 1.645 * 1.645 / n)) AS ub FROM s)"""


@query("saving_per_regression", _METHODS + """
SELECT method, round(saving, 4) AS saving, k::BIGINT AS regressions, round(CASE WHEN k > 0 THEN saving / k END, 4) + 0.0 AS per_regression,
 row_number() OVER (ORDER BY coalesce(CASE WHEN k > 0 THEN saving / k END, saving) DESC, method)::BIGINT AS rank,
 CASE WHEN k >= 2 OR saving <= 0 THEN 'KILL' WHEN saving > 0 THEN 'PROCEED_TO_FULL' ELSE 'WEAK' END AS screen,
 CASE WHEN ub <= 0.1 AND saving > 0 THEN 'GLOBAL_SAFE' WHEN k > 0 THEN 'UNSAFE' ELSE 'INCONCLUSIVE' END AS full_run FROM b""")
def _(spark, d):
    """Saving per regression, the rank by it, and both tiers of verdicts."""
    from ..functions.columns import wilson_upper

    p = ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE)
    m = p.groupBy("method").agg((100 * (F.sum("base") - F.sum("cost")) / F.sum("base")).alias("saving"), F.count_if(F.col("saving") < -500).alias("regressions"), F.count(F.lit(1)).alias("n"))
    r = audits.saving_per_regression(m)
    c, ub = F.col, wilson_upper(F.col("regressions"), F.col("n"))
    return r.select("method", "saving", "regressions", "per_regression", "rank", audits.kill_tier(c("regressions"), c("saving"), ub, False).alias("screen"), audits.kill_tier(c("regressions"), c("saving"), ub, True).alias("full_run"))


_BOTH = L + ", w AS (SELECT task_id, max(base) AS base, max(saving) FILTER (method = 'A') AS sa, max(saving) FILTER (method = 'R') AS sr FROM p GROUP BY 1)"


@query("contrast_tags", _BOTH + """
SELECT task_id, concat_ws(',', CASE WHEN sa > 5 THEN 'DEDUP_helped' WHEN sa < -5 THEN 'DEDUP_hurt' WHEN sa IS NOT NULL THEN 'DEDUP_neutral' END,
 CASE WHEN sr > 5 THEN 'CAP_helped' WHEN sr < -5 THEN 'CAP_hurt' WHEN sr IS NOT NULL THEN 'CAP_neutral' END, CASE WHEN base > 20000 THEN 'high_cost' ELSE 'ordinary_cost' END) AS tags FROM w""")
def _(spark, d):
    """What each method did to a task, and whether the task is costly."""
    p = ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE)
    return audits.contrast_tags(p, {"A": "DEDUP", "R": "CAP"}, 20000).select("task_id", F.array_join("tags", ",").alias("tags"))


@query("blind_verdicts", _BOTH + """, a AS (SELECT *, CASE task_id % 5 WHEN 0 THEN 'NO_OP' WHEN 1 THEN 'GENTLE_CAP' WHEN 2 THEN 'OTHER' ELSE 'LINE_DEDUP' END AS action, CASE task_id % 3 WHEN 0 THEN 'decrease' WHEN 1 THEN 'increase' ELSE 'neutral' END AS predicted FROM w),
b AS (SELECT *, CASE action WHEN 'LINE_DEDUP' THEN sa WHEN 'GENTLE_CAP' THEN sr END AS x FROM a)
SELECT CASE WHEN action = 'NO_OP' THEN CASE WHEN sa IS NULL OR sr IS NULL THEN 'UNIDENTIFIED' WHEN greatest(sa, sr) <= 5 THEN 'VALIDATED_CANDIDATE' ELSE 'REJECTED' END WHEN action = 'OTHER' THEN 'UNIDENTIFIED'
 WHEN x IS NULL THEN 'INSUFFICIENT_COUNTERFACTUAL' WHEN predicted = 'decrease' THEN CASE WHEN x > 5 THEN 'VALIDATED_CANDIDATE' WHEN x < -5 THEN 'REJECTED' ELSE 'CONDITIONALLY_VALID' END
 WHEN predicted = 'increase' THEN CASE WHEN x < -5 THEN 'VALIDATED_CANDIDATE' WHEN x > 5 THEN 'REJECTED' ELSE 'CONDITIONALLY_VALID' END
 WHEN abs(x) <= 5 THEN 'VALIDATED_CANDIDATE' ELSE 'CONDITIONALLY_VALID' END AS verdict, task_id FROM b""")
def _(spark, d):
    """Were blind predictions of an action's effect borne out?"""
    p = ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE)
    s = p.groupBy("task_id").agg(*(F.max(F.when(F.col("method") == m, F.col("saving"))).alias(n) for m, n in (("A", "sa"), ("R", "sr"))))
    k, k3 = F.col("task_id") % 5, F.col("task_id") % 3
    action = F.when(k == 0, "NO_OP").when(k == 1, "GENTLE_CAP").when(k == 2, "OTHER").otherwise("LINE_DEDUP")
    predicted = F.when(k3 == 0, "decrease").when(k3 == 1, "increase").otherwise("neutral")
    return s.select(audits.blind_verdict(action, predicted, F.col("sa"), F.col("sr")).alias("verdict"), "task_id")


@query("task_classes", """WITH r AS (SELECT user_id AS task, CASE event_type WHEN 'view' THEN 'c' WHEN 'click' THEN 's' WHEN 'purchase' THEN 'm' END AS arm, event_id AS rep, value > 30 AS passed, value > 60 AS fired FROM events),
t AS (SELECT task, list(passed ORDER BY rep) FILTER (arm = 'c') AS c, list(passed ORDER BY rep) FILTER (arm = 's') AS s, list(passed ORDER BY rep) FILTER (arm = 'm') AS m, count(*) FILTER (arm = 'm' AND fired) AS f FROM r WHERE arm IS NOT NULL GROUP BY 1),
x AS (SELECT *, len(list_filter(c, lambda v: v)) / len(c) AS pc, len(list_filter(m, lambda v: v)) / len(m) AS pm FROM t)
SELECT task, CASE WHEN c IS NULL OR s IS NULL OR m IS NULL THEN 'INCONCLUSIVE' WHEN len(list_distinct(c)) > 1 OR len(list_distinct(s)) > 1 THEN 'INHERENTLY_UNSTABLE' WHEN f = 0 AND m <> c THEN 'NO_OP_FALSE_ATTRIBUTION'
 WHEN pc > 0.5 AND pm < 0.5 AND f > 0 THEN 'TRUE_PRUNING_FRAGILITY' WHEN pc <= 0.5 AND pm > 0.5 AND f > 0 THEN 'TRUE_PRUNING_IMPROVEMENT' WHEN m = c THEN 'STABLE_NO_EFFECT' ELSE 'INCONCLUSIVE' END AS task_class FROM x""")
def _(spark, d):
    """The six classes of tasks from repeated outcomes of three arms."""
    kind = F.col("event_type")
    arm = F.when(kind == "view", "control").when(kind == "click", "sham").when(kind == "purchase", "method")
    reps = tables.read(spark, d, "events").select(F.col("user_id").alias("task"), arm.alias("arm"), F.col("event_id").alias("rep"), (F.col("value") > 30).alias("passed"), (F.col("value") > 60).alias("fired"))
    return audits.task_classes(reps.where("arm is not null"))


@query("agreement_gates", f"""SELECT 'alpha' AS gate, round(coalesce(nullif(alpha, 0), nullif(agreement, 0), 0), 4) AS value, coalesce(nullif(alpha, 0), nullif(agreement, 0), 0) >= 0.67 AS passed FROM ({SQL['krippendorff_alpha']}), ({SQL['raw_agreement']})
UNION ALL SELECT 'zero_alpha', round(coalesce(nullif(0.0, 0), nullif(agreement, 0), 0), 4), coalesce(nullif(agreement, 0), 0) >= 0.67 FROM ({SQL['raw_agreement']})""")
def _(spark, d):
    """Gates on agreement, where a zero counts as missing."""
    votes = tables.votes(spark, d)
    both = agreement.krippendorff(votes).join(F.broadcast(agreement.raw_agreement(votes)))  # one row each
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), audits.gate_value(a, F.col("agreement")).alias("value")) for n, a in (("alpha", F.col("alpha")), ("zero_alpha", F.lit(0.0)))))
    return both.select(F.explode(rows).alias("g")).select("g.gate", "g.value", (F.col("g.value") >= audits.GATE).alias("passed"))


@query("evidence_overlap", """WITH v AS (SELECT l_orderkey AS unit, l_returnflag AS label, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS rater, list(DISTINCT l_partkey % 3) AS e FROM lineitem GROUP BY 1, 2, 3)
SELECT a.unit, a.label, round(len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))), 4) AS overlap FROM v a JOIN v b ON a.unit = b.unit AND a.label = b.label AND a.rater < b.rater""")
def _(spark, d):
    """Overlap of two raters' evidence for the labels that both gave."""
    li = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("label"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("rater"), (F.col("l_partkey") % 3).alias("e"))
    return audits.evidence_overlap(li.groupBy("unit", "label", "rater").agg(F.collect_set("e").alias("evidence")))


@query("decision_events", L + """SELECT method, CASE WHEN changed THEN 'FIRED' ELSE 'NO_OP_ELIGIBLE' END AS event, CASE WHEN call_index = 1 OR NOT changed THEN 'PAIRED_TASK_ONLY' ELSE 'UNIDENTIFIED' END AS counterfactual, count(*)::BIGINT AS n FROM l GROUP BY 1, 2, 3""")
def _(spark, d):
    """Decisions that fired or could have, and what their counterfactual is."""
    return ledger.decision_events(tables.ledger(spark, d), F.col("call_index") == 1)


@query("ledger_inventory", L + """SELECT method, count(*)::BIGINT AS calls, count(*) FILTER (task_id % 11 = 0)::BIGINT AS unknown_calls, count(DISTINCT task_id) FILTER (task_id % 11 <> 0)::BIGINT AS tasks,
 round(sum(input_tokens + cache_read_tokens + cache_creation_tokens), 4) AS input_side, round(sum(output_tokens), 4) AS output,
 round(avg(input_tokens + cache_read_tokens) FILTER (input_tokens + cache_read_tokens > 0), 4) AS mean_prompt FROM l GROUP BY 1""")
def _(spark, d):
    """Calls, unknown calls, tasks, raw tokens and mean prompt of each method's ledger."""
    calls = tables.ledger(spark, d).withColumn("task", F.when(F.col("task_id") % 11 == 0, F.concat(F.lit("UNKNOWN_"), "task_id")).otherwise(F.col("task_id").cast("string")))
    return ledger.inventory([calls.where(F.col("method") == m) for m in "ANR"], "task")


@query("mechanism", L + """SELECT component, round(avg(v) FILTER (changed), 4) AS mean_1, round(avg(v) FILTER (NOT changed), 4) AS mean_0, round(avg(v) FILTER (changed) - avg(v) FILTER (NOT changed), 4) AS diff
FROM (SELECT changed, unnest([{'component': 'input_tokens', 'v': input_tokens}, {'component': 'cache_read_tokens', 'v': cache_read_tokens}, {'component': 'cache_creation_tokens', 'v': cache_creation_tokens}, {'component': 'output_tokens', 'v': output_tokens}], recursive := true) FROM l) GROUP BY 1""")
def _(spark, d):
    """Z3: both arms' means of each token component and their difference."""
    return ledger.mechanism(tables.ledger(spark, d), "changed")


@query("activation_rate", L + "SELECT method, round(avg((changed_calls > 0)::INT), 4) AS activated, count(*)::BIGINT AS treated FROM t WHERE method <> 'N' GROUP BY 1")
def _(spark, d):
    """The share of treated tasks where something changed."""
    c = ledger.task_cost(tables.with_cost(tables.ledger(spark, d))).where(F.col("method") != tables.BASELINE)
    return c.groupBy("method").agg(F.avg((F.col("changed_calls") > 0).cast("int")).alias("activated"), F.count(F.lit(1)).alias("treated"))


@query("threshold_policies", G + ", k AS (SELECT * FROM g, (VALUES (0.3), (0.4), (0.5)) c(cut)) SELECT cut::DOUBLE AS threshold, round(sum(y) FILTER (a = (moderator > cut)::INT) / count(*) FILTER (a = (moderator > cut)::INT), 4) AS hajek, round(2 * sum(y) FILTER (a = (moderator > cut)::INT) / count(*), 4) AS ipw FROM k GROUP BY 1")
def _(spark, d):
    """Value of acting above each threshold of the signal."""
    cuts = (0.3, 0.4, 0.5)
    got = statistics.hajek(tables.trial(spark, d), {str(c): (F.col("moderator") > c).cast("int") for c in cuts})
    return got.select(F.col("policy").cast("double").alias("threshold"), "hajek", "ipw")


@query("consistency", """SELECT 'lines_have_orders' AS name, count(*) = 0 AS passed, count(*)::VARCHAR AS detail FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_have_customers', count(*) = 0, count(*)::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'labels_are_known', count(*) = 0, count(*)::VARCHAR FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'stated_length', count(*) = 0, count(*)::VARCHAR FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'few_top_labels', count(*) <= 7, count(*)::VARCHAR FROM region UNION ALL SELECT 'few_labels', count(*) <= 22, count(*)::VARCHAR FROM nation
UNION ALL SELECT 'required_fields', count(*) = 0, count(*)::VARCHAR FROM nation WHERE n_name IS NULL OR n_regionkey IS NULL""")
def _(spark, d):
    """Checks of tables against each other, of stated against counted, of a taxonomy's bounds."""
    t = lambda n: tables.read(spark, d, n)
    none = lambda df: df.agg((F.count(F.lit(1)) == 0).alias("passed"), F.count(F.lit(1)).alias("detail"))
    most = lambda df, k: df.agg((F.count(F.lit(1)) <= k).alias("passed"), F.count(F.lit(1)).alias("detail"))
    return audits.assertions({
        "lines_have_orders": none(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        "orders_have_customers": none(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        "labels_are_known": none(t("labels").where("quality not in (0, 1) or toxic not in (0, 1)")), "stated_length": none(t("documents").where("n_chars <> length(text)")),
        "few_top_labels": most(t("region"), 7), "few_labels": most(t("nation"), 22), "required_fields": none(t("nation").where("n_name is null or n_regionkey is null")),
    })


@query("artifact_hashes", """SELECT doc_id AS artifact, sha256(coalesce(text, '')) = sha256(CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END) AS unchanged FROM documents""")
def _(spark, d):
    """Artifacts whose content hash is still the recorded one."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("artifact"), F.coalesce("text", F.lit("")).alias("text"))
    recorded = docs.select("artifact", F.sha2(F.when(F.col("artifact") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    return docs.join(recorded, "artifact").select("artifact", (F.sha2("text", 256) == F.col("sha")).alias("unchanged"))


@query("pooled_dedupe", """WITH a AS (SELECT 0 AS k, 'benchmark' AS s, md5(coalesce(text, '')) AS h FROM benchmark UNION ALL SELECT 1, 'documents', md5(coalesce(text, '')) FROM documents UNION ALL SELECT 2, 'conversations', md5(coalesce(text, '')) FROM conversations)
SELECT s AS from_set, count(*)::BIGINT AS n FROM (SELECT h, min_by(s, k) AS s FROM a GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    """Texts of three sets, each kept in the first set that has it."""
    texts = {n: tables.read(spark, d, n).select(F.md5(F.coalesce("text", F.lit(""))).alias("h")) for n in ("benchmark", "documents", "conversations")}
    return audits.pooled(texts, "h").groupBy("from_set").agg(F.count(F.lit(1)).alias("n"))


@query("vote_coverage", V + ", u AS (SELECT unit, count(label) AS votes, count(*) FILTER (label IS NULL) AS unparsed FROM v GROUP BY 1) SELECT votes::BIGINT AS votes, count(*)::BIGINT AS units, sum(unparsed)::BIGINT AS unparsed FROM u GROUP BY 1")
def _(spark, d):
    """How many units have how many readable votes."""
    u = tables.votes(spark, d).groupBy("unit").agg(F.count("label").alias("votes"), F.count_if(F.col("label").isNull()).alias("unparsed"))
    return u.groupBy("votes").agg(F.count(F.lit(1)).alias("units"), F.sum("unparsed").alias("unparsed"))


_RULES = [(r"https?://[a-z0-9.-]+", "HOST"), (r"/[A-Z][a-z]+", "/NAME"), (r"[0-9]+", "N"), (r"NAMEN", "NAME")]


@query("blinding", "SELECT page_id, " + "".join("regexp_replace(" for _ in _RULES) + "url" + "".join(f", '{p}', '{r}', 'g')" for p, r in _RULES) + " AS blinded, false AS still_named FROM pages")
def _(spark, d):
    """P16 (its rules are a parameter), U3: locators after ordered rules, and what a scan still finds."""
    b = tables.read(spark, d, "pages").select("page_id", audits.blind(F.col("url"), _RULES).alias("blinded"))
    return b.withColumn("still_named", audits.still_named(F.col("blinded"), _RULES[:3]))


@query("correlations", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_quantity, l_tax) AS ad, corr(l_extendedprice, l_discount) AS bc, corr(l_extendedprice, l_tax) AS bd, corr(l_discount, l_tax) AS cd FROM lineitem)
SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS a, unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS b, round(unnest([ab, ac, ad, bc, bd, cd]), 4) AS r,
 unnest([ab, ac, ad, bc, bd, cd]) = greatest(ab, ac, ad, bc, bd, cd) AS most FROM c""")
def _(spark, d):
    """Correlations of features and which is the greatest off the diagonal."""
    return statistics.correlations(tables.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("robust_means", G + """, q AS (SELECT quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM g)
SELECT a::BIGINT AS a, round(avg(least(greatest(y, lo), hi)), 4) AS winsorised, round(avg(y) FILTER (y BETWEEN lo AND hi), 4) AS trimmed, round(avg(ln(1 + y)), 4) AS log_mean, round(median(y), 4) AS median FROM g, q GROUP BY 1""")
def _(spark, d):
    """arms' means with extremes pulled in, cut off, in logarithms, and medians."""
    return statistics.robust_means(tables.trial(spark, d), 0.05)


@query("skewness", "WITH c AS (SELECT o_orderpriority AS grp, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) SELECT grp, round(avg(pow(y - m, 3)) / pow(avg(pow(y - m, 2)), 1.5), 4) AS skewness, round(avg(pow(y - m, 4)) / pow(avg(pow(y - m, 2)), 2) - 3, 4) AS kurtosis, round(max(y) / median(y), 4) AS max_over_median, round(stddev_samp(y) / avg(y), 4) AS cv FROM c GROUP BY 1")
def _(spark, d):
    """Shape of prices in each group: skewness, kurtosis, maximum over median, variation."""
    return statistics.moments(tables.read(spark, d, "orders").withColumnRenamed("o_orderpriority", "grp"), "grp", value="o_totalprice").select("grp", "skewness", "kurtosis", "max_over_median", "cv")


@query("in_sample_dr", G + """, m AS (SELECT stratum, a, avg(y) AS mu FROM g GROUP BY 1, 2), f AS (SELECT g.*, max(m.mu) FILTER (m.a = 1) AS m1, max(m.mu) FILTER (m.a = 0) AS m0 FROM g JOIN m ON g.stratum = m.stratum GROUP BY ALL)
SELECT round(avg(m1 + CASE WHEN a = 1 THEN (y - m1) / 0.5 ELSE 0 END), 4) AS value_1, round(avg(m0 + CASE WHEN a = 0 THEN (y - m0) / 0.5 ELSE 0 END), 4) AS value_0, count(*)::BIGINT AS n FROM f WHERE m1 IS NOT NULL AND m0 IS NOT NULL""")
def _(spark, d):
    """Doubly robust values with the strata's own means."""
    return statistics.in_sample_dr(tables.trial(spark, d))
