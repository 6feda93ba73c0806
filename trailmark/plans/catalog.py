"""Named queries over the test tables and their DuckDB twins.

Every query runs an operator over its whole table.  Results are cast to long, double
(rounded) and string so that both engines' values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import agreement, ledger, messages, ranks, sequence, statistics, studies
from ..sources import tables

QUERY = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QUERY] = {}
SQL: dict[str, str] = {}
DIGITS = 4


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, other numbers as rounded double."""

    def cast(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(c.cast("double"), DIGITS).alias(f.name)
        return c

    return df.select(*(cast(f) for f in df.schema.fields))


def query(name: str, sql: str | None = None) -> Callable[[QUERY], QUERY]:
    def add(f: QUERY) -> QUERY:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return add


E = """WITH e AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_index,
 CASE event_type WHEN 'error' THEN 'TOOL_ERROR' WHEN 'view' THEN 'READ' WHEN 'click' THEN 'SEARCH' WHEN 'purchase' THEN 'EDIT' WHEN 'signup' THEN 'TEST' ELSE 'OTHER' END AS etype,
 substr(sha256(concat_ws('|', event_type, props)), 1, 16) AS args_hash, substr(sha256(props), 1, 16) AS output_hash, props AS target, value FROM events)"""
L = """WITH l AS (SELECT l_orderkey AS task_id, l_returnflag AS method, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS call_index, l_quantity AS input_tokens, l_extendedprice AS cache_read_tokens,
 l_tax * 1000 AS cache_creation_tokens, l_discount * 100 AS output_tokens, l_linestatus = 'F' AS changed, l_partkey AS chars_removed, l_suppkey AS repo_id,
 l_quantity + 0.1 * l_extendedprice + 1.25 * l_tax * 1000 + 5 * l_discount * 100 AS cost FROM lineitem),
 t AS (SELECT task_id, method, sum(cost) AS cost, count(*) AS calls, count(*) FILTER (changed) AS changed_calls, sum(CASE WHEN changed THEN chars_removed ELSE 0 END) AS chars_removed FROM l GROUP BY ALL),
 w0 AS (SELECT *, max(cost) FILTER (method = 'N') OVER (PARTITION BY task_id) AS base FROM t),
 p AS (SELECT task_id, method, base, cost, 100 * (base - cost) / base AS saving FROM w0 WHERE method <> 'N' AND base > 0)"""
G = """WITH g AS (SELECT l.doc_id AS task_id, d.source AS cluster, d.lang, l.quality = 1 AS baseline, l.toxic = 0 AS candidate, d.n_chars::DOUBLE AS y,
 CASE WHEN l.quality = 1 THEN 'HIGH' ELSE 'MIXED' END AS stratum, l.toxic::INT AS a, (l.doc_id % 97) / 97.0 AS moderator FROM labels l JOIN documents d USING (doc_id))"""
V = """WITH d0 AS (SELECT doc_id AS unit, lang, r.rater FROM documents, (VALUES ('r1'), ('r2'), ('r3')) r(rater)),
 d1 AS (SELECT *, ('0x' || substr(sha256(unit::VARCHAR || '|' || rater), 1, 1))::INT AS digit FROM d0),
 v AS (SELECT unit, rater, CASE WHEN digit < 10 THEN lang WHEN digit < 13 THEN 'en' WHEN digit < 15 THEN 'xx' END AS label,
 list_filter([CASE WHEN digit % 2 = 0 THEN 'A' END, CASE WHEN digit % 3 = 0 THEN 'B' END, CASE WHEN digit > 7 THEN 'C' END, CASE WHEN digit % 5 = 1 THEN 'D' END], lambda x: x IS NOT NULL) AS labels FROM d1)"""
M = """WITH m AS (SELECT conv_id AS req_id, turn AS idx, role, coalesce(text, '') AS text, role = 'assistant' AND turn > 1 AS is_obs FROM conversations)"""
DM = """WITH m AS (SELECT doc_id // 32 AS req_id, doc_id % 32 AS idx, 'user' AS role, coalesce(text, '') AS text, doc_id % 32 > 1 AS is_obs FROM documents)"""


# --- ledgers ------------------------------------------------------------------
@query("task_effective_cost", L + "SELECT task_id, method, round(cost, 4) AS cost, calls::BIGINT AS calls, changed_calls::BIGINT AS changed_calls, chars_removed::BIGINT AS chars_removed FROM t")
def _(spark, d):
    """Cost of each task and method."""
    return ledger.task_cost(tables.with_cost(tables.ledger(spark, d)))


def _pairs(spark, d):
    return ledger.paired(ledger.task_cost(tables.with_cost(tables.ledger(spark, d))), tables.BASELINE)


@query("paired_saving", L + "SELECT task_id, method, round(base, 4) AS base, round(cost, 4) AS cost, round(saving, 4) AS saving FROM p")
def _(spark, d):
    """Saving of each candidate against its task's baseline."""
    return _pairs(spark, d)


_WILSON = "CASE WHEN n > 0 THEN least(1.0, (k / n + 1.645 * 1.645 / 2 / n + 1.645 * sqrt(k / n * (1 - k / n) / n + 1.645 * 1.645 / 4 / (n * n))) / (1 + 1.645 * 1.645 / n)) ELSE 1.0 END"
_FRONTIER = (
    L
    + f""", o AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS k, count(*) FILTER (quality = 1)::DOUBLE AS n FROM labels),
 s AS (SELECT method, median(saving) AS ms, avg(saving) AS av, count(*) AS pairs FROM p GROUP BY 1), j AS (SELECT s.*, o.k, {_WILSON} AS ub FROM s, o)
 SELECT method, pairs::BIGINT AS pairs, round(ms, 4) AS median_saving, round(av, 4) AS mean_saving, k::BIGINT AS regressions, round(ub, 4) AS loss_ub,
 CASE WHEN k = 0 THEN 'STRICT' WHEN ub <= 0.06 THEN 'LOW' WHEN ub <= 0.15 THEN 'MEDIUM' WHEN ub <= 0.30 THEN 'HIGH' ELSE 'UNSAFE' END AS tier,
 CASE WHEN ms > 2 AND ub <= 0.10 THEN 'win' WHEN ms > 0 THEN 'marginal' ELSE 'no saving' END AS verdict, row_number() OVER (ORDER BY ms DESC, method)::BIGINT AS rank FROM j"""
)


@query("pareto_frontier", _FRONTIER)
def _(spark, d):
    """Methods by median saving with loss bound, risk tier and verdict."""
    return ledger.frontier(_pairs(spark, d), ledger.outcome_counts(tables.grades(spark, d)))


@query("regression_events", G + "SELECT task_id, cluster, CASE WHEN baseline AND NOT candidate THEN 'REGRESSION' WHEN NOT baseline AND candidate THEN 'IMPROVEMENT' WHEN baseline THEN 'both_pass' ELSE 'both_fail' END AS verdict FROM g")
def _(spark, d):
    """Verdict of each paired outcome."""
    g = tables.grades(spark, d)
    return g.select("task_id", "cluster", C.verdict(F.col("baseline"), F.col("candidate")).alias("verdict"))


@query("regressed_tasks_anti", "SELECT doc_id AS task_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def _(spark, d):
    """baseline's solved tasks that the candidate doesn't solve, by anti join."""
    g = tables.read(spark, d, "labels")
    return g.where("quality = 1").select(F.col("doc_id").alias("task_id")).join(g.where("toxic = 0").select(F.col("doc_id").alias("task_id")), "task_id", "left_anti")


@query("denominator_semi", "SELECT lang, count(*)::BIGINT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def _(spark, d):
    """Tasks that were run, by semi join."""
    docs = tables.read(spark, d, "documents").select("doc_id", "lang")
    return docs.join(tables.read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("outcomes_by_cluster", G + f", c AS (SELECT cluster, count(*) FILTER (baseline AND NOT candidate)::DOUBLE AS k, count(*) FILTER (NOT baseline AND candidate) AS i, count(*) FILTER (baseline)::DOUBLE AS n, count(*) AS m FROM g GROUP BY 1) SELECT cluster, k::BIGINT AS regressions, i::BIGINT AS improvements, n::BIGINT AS solved, m::BIGINT AS n, round({_WILSON}, 4) AS loss_ub FROM c")
def _(spark, d):
    """Outcome counts and Wilson bound of each cluster."""
    return ledger.outcome_counts(tables.grades(spark, d), "cluster")


@query("leave_top_k", L + ", r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY base DESC, task_id) AS rn FROM p) SELECT method, k.k::BIGINT AS k, round(100 * (sum(base) - sum(cost)) / sum(base), 4) AS saving FROM r, (VALUES (0), (1), (3), (5)) k(k) WHERE rn > k.k GROUP BY method, k.k")
def _(spark, d):
    """Saving without the k most expensive tasks."""
    return ledger.leave_top_out(_pairs(spark, d))


@query("oracle_policy", L + "SELECT method, round(sum(base), 4) AS baseline, round(sum(cost), 4) AS candidate, round(sum(least(base, cost)), 4) AS oracle, round(sum(CASE WHEN base >= 10000 THEN cost ELSE base END), 4) AS gated FROM p GROUP BY 1")
def _(spark, d):
    """Totals of policies."""
    return ledger.policies(_pairs(spark, d), 10000)


SCHEMES = {"cached": (1.0, 0.1, 1.25, 5.0), "uncached": (1.0, 1.0, 1.0, 5.0), "flat": (1.0, 1.0, 1.0, 1.0), "free_read": (1.0, 0.0, 1.25, 5.0), "output_heavy": (1.0, 0.1, 1.25, 8.0)}


@query("reprice_schemes", L + ", s(scheme, a, b, c, e) AS (VALUES " + ", ".join(f"('{n}', {', '.join(map(str, w))})" for n, w in SCHEMES.items()) + ") SELECT method, scheme, round(sum(a * input_tokens + b * cache_read_tokens + c * cache_creation_tokens + e * output_tokens), 4) AS cost FROM l, s GROUP BY 1, 2")
def _(spark, d):
    """Totals under five price vectors."""
    return ledger.reprice(tables.ledger(spark, d), SCHEMES)


@query("cost_decomposition", L + "SELECT method, round(sum(input_tokens) / sum(cost), 4) AS input_share, round(0.1 * sum(cache_read_tokens) / sum(cost), 4) AS cache_read_share, round(1.25 * sum(cache_creation_tokens) / sum(cost), 4) AS cache_creation_share, round(5 * sum(output_tokens) / sum(cost), 4) AS output_share FROM l GROUP BY 1")
def _(spark, d):
    """Parts of cost by component."""
    return ledger.decomposition(tables.ledger(spark, d), C.COST_WEIGHTS)


@query("cache_ratio", L + "SELECT method, round(sum(cache_read_tokens) / greatest(sum(cache_creation_tokens), 1), 4) AS ratio, count(*)::BIGINT AS calls FROM l GROUP BY 1")
def _(spark, d):
    """Cache reads for each cache creation."""
    return ledger.cache_ratio(tables.ledger(spark, d))


@query("dose_median", L + "SELECT method, round(median(chars_removed), 4) AS dose, count(*)::BIGINT AS changed FROM l WHERE changed GROUP BY 1")
def _(spark, d):
    """Median removal where something changed."""
    calls = tables.ledger(spark, d).where("changed")
    return ranks.with_quantiles(calls, calls.groupBy("method").agg(F.count(F.lit(1)).alias("changed")), ["method"], "chars_removed", dose=0.5)


@query("first_divergence", L + ", f AS (SELECT task_id, call_index, min(call_index) FILTER (changed) OVER (PARTITION BY task_id) AS fd FROM l) SELECT task_id, max(fd)::BIGINT AS first_divergence, count(*) FILTER (fd IS NULL OR call_index < fd)::BIGINT AS matched_prefix FROM f GROUP BY 1")
def _(spark, d):
    """First changed call and length of the matched prefix."""
    return sequence.matched_prefix(tables.ledger(spark, d), "task_id", "call_index", F.col("changed"))


@query("horizon_h3", L + ", f AS (SELECT *, min(call_index) FILTER (changed) OVER (PARTITION BY task_id) AS s FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY call_index) AS n FROM f WHERE call_index >= s) SELECT task_id, round(sum(cost), 4) AS total, count(*)::BIGINT AS taken, count(*) < 3 AS truncated FROM k WHERE n <= 3 GROUP BY 1")
def _(spark, d):
    """Cost of the first changed call and the two after it."""
    return sequence.horizon(tables.with_cost(tables.ledger(spark, d)), "task_id", "call_index", F.col("changed"), "cost")


@query("relational_division", "SELECT l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def _(spark, d):
    """Suppliers with orders of every priority."""
    j = tables.read(spark, d, "lineitem").join(tables.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("supplier"), "o_orderpriority")
    return ledger.relational_division(j, "supplier", "o_orderpriority")


@query("overlap_matrix", L + ", u AS (SELECT DISTINCT task_id, method FROM l) SELECT a.method AS a, b.method AS b, count(*)::BIGINT AS shared FROM u a JOIN u b ON a.task_id = b.task_id AND a.method <= b.method GROUP BY 1, 2")
def _(spark, d):
    """Tasks that each two methods share."""
    return ledger.overlap(tables.ledger(spark, d), "task_id", "method")


@query("task_quartile_cap", "WITH c AS (SELECT o_orderpriority AS grp, quantile_cont(o_totalprice, 0.75) AS cut FROM orders GROUP BY 1) SELECT grp, round(max(cut), 4) AS cut, count(*)::BIGINT AS n FROM orders JOIN c ON o_orderpriority = grp WHERE o_totalprice >= cut GROUP BY 1")
def _(spark, d):
    """Rows at or above their group's third quartile."""
    o = tables.read(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice")
    return ledger.quantile_cap(o, "grp", "o_totalprice", 0.75)


@query("exclusive_tertiles", "WITH s AS (SELECT c_mktsegment AS grp, list_sort(list(c_acctbal)) AS s, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT *, least(greatest((n + 1) // 3, 1), n - 1) AS w1, least(greatest(2 * (n + 1) // 3, 1), n - 1) AS w2 FROM s WHERE n > 1) SELECT grp, round((s[w1] * (3 - (n + 1 - w1 * 3)) + s[w1 + 1] * (n + 1 - w1 * 3)) / 3, 4) AS low, round((s[w2] * (3 - (2 * (n + 1) - w2 * 3)) + s[w2 + 1] * (2 * (n + 1) - w2 * 3)) / 3, 4) AS high FROM w")
def _(spark, d):
    """Tertiles by the exclusive method."""
    return ledger.exclusive_tertiles(tables.read(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), "c_acctbal"), "grp", "c_acctbal")


@query("mode_first_seen", E + ", c AS (SELECT trace_id, etype, count(*) AS n, min(event_index) AS f FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, f) AS rn FROM c) SELECT trace_id, etype, n::BIGINT AS n FROM r WHERE rn = 1")
def _(spark, d):
    """Most frequent type of each trace, ties to the one seen first."""
    return ledger.mode(tables.events(spark, d), "trace_id", "etype", "event_index")


@query("eta_squared", "WITH g AS (SELECT n_regionkey AS k, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 4) AS eta_sq FROM g")
def _(spark, d):
    """Variance of balances between regions."""
    c = tables.read(spark, d, "customer").join(F.broadcast(tables.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return ledger.eta_squared(c, "n_regionkey", "c_acctbal")


@query("label_prevalence_tier", E + ", f AS (SELECT trace_id, count(*) FILTER (etype = 'TOOL_ERROR') AS err, count(*) FILTER (etype = 'EDIT') AS ed, count(*) FILTER (etype = 'TEST') AS te FROM e GROUP BY 1), p AS (SELECT unnest([{'label': 'PATCH_CHURN', 'v': (ed >= 5)::INT}, {'label': 'VERIFICATION_GAP', 'v': (te = 0)::INT}, {'label': 'TOOL_FAILURES', 'v': (err >= 3)::INT}], recursive := true) FROM f) SELECT label, round(100 * avg(v), 4) AS prevalence, CASE WHEN 100 * avg(v) >= 40 THEN 'HIGH' WHEN 100 * avg(v) >= 15 THEN 'MED' WHEN 100 * avg(v) >= 5 THEN 'LOW' ELSE 'NONE' END AS tier FROM p GROUP BY 1")
def _(spark, d):
    """Prevalence of proxy labels and their tiers."""
    f = sequence.trace_features(tables.events(spark, d))
    proxies = {"PATCH_CHURN": F.col("edits") >= 5, "VERIFICATION_GAP": F.col("tests") == 0, "TOOL_FAILURES": F.col("errors") >= 3}
    long = f.select(F.explode(F.array(*(F.struct(F.lit(n).alias("label"), p.cast("int").alias("v")) for n, p in proxies.items()))).alias("p")).select("p.*")
    share = 100 * F.avg("v")
    return long.groupBy("label").agg(share.alias("prevalence"), F.when(share >= 40, "HIGH").when(share >= 15, "MED").when(share >= 5, "LOW").otherwise("NONE").alias("tier"))


@query("stability", G + ", c AS (SELECT cluster, count(DISTINCT baseline) AS b, count(*) AS n FROM g GROUP BY 1) SELECT cluster, n::BIGINT AS n, CASE WHEN n < 2 THEN 'INSUFFICIENT' WHEN b = 1 THEN 'STABLE' ELSE 'MIXED' END AS stability FROM c")
def _(spark, d):
    """Do all outcomes of a cluster agree?"""
    g = tables.grades(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("baseline").alias("b"))
    return g.select("cluster", "n", F.when(F.col("n") < 2, "INSUFFICIENT").when(F.col("b") == 1, "STABLE").otherwise("MIXED").alias("stability"))


@query("stratified_sample", G + ", r AS (SELECT task_id AS unit, cluster, row_number() OVER (PARTITION BY cluster ORDER BY sha256(task_id::VARCHAR), task_id) AS round, count(*) OVER (PARTITION BY cluster) AS n FROM g) SELECT unit, cluster, round::BIGINT AS round FROM r ORDER BY round, n, cluster, unit LIMIT 60")
def _(spark, d):
    """Round-robin sample over strata (60 units are what is asked for)."""
    g = tables.grades(spark, d).select(F.col("task_id").alias("unit"), "cluster")
    return ledger.stratified_sample(g, "cluster", "unit", 60)


@query("group_folds", "SELECT (('0x' || substr(sha256(o_custkey::VARCHAR), 1, 8))::BIGINT % 5)::BIGINT AS fold, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS units FROM orders GROUP BY 1")
def _(spark, d):
    """Folds by unit."""
    f = ledger.group_folds(tables.read(spark, d, "orders"), "o_custkey", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("units"))


@query("split_leak_audit", "WITH s AS (SELECT l_partkey AS unit, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'validation' ELSE 'test' END AS part FROM lineitem) SELECT unit, count(DISTINCT part)::BIGINT AS parts, string_agg(DISTINCT part, ',' ORDER BY part) AS names FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1")
def _(spark, d):
    """Parts that more than one side of a split by order has."""
    k = F.col("l_orderkey") % 10
    s = tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"), F.when(k < 7, "train").when(k < 9, "validation").otherwise("test").alias("part"))
    return ledger.split_leaks(s, "unit", "part")


@query("assignment_conflicts", "SELECT l_orderkey AS task_id, count(DISTINCT l_returnflag)::BIGINT AS arms FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _(spark, d):
    """Tasks with more than one assignment."""
    return ledger.assignment_conflicts(tables.ledger(spark, d), "task_id", "method")


# --- sequences ------------------------------------------------------------------
_err = "TOOL_ERROR"


@query("trace_features", E + ", x AS (SELECT *, lag(etype) OVER (PARTITION BY trace_id ORDER BY event_index) AS b, count(args_hash) OVER (PARTITION BY trace_id, args_hash) AS c FROM e) SELECT trace_id, count(*)::BIGINT AS n_events, count(*) FILTER (etype = 'SEARCH')::BIGINT AS searches, count(*) FILTER (etype = 'READ')::BIGINT AS reads, count(*) FILTER (etype = 'EDIT')::BIGINT AS edits, count(*) FILTER (etype = 'TEST')::BIGINT AS tests, count(*) FILTER (etype = 'TOOL_ERROR')::BIGINT AS errors, min(event_index) FILTER (etype = 'SEARCH') AS first_search, min(event_index) FILTER (etype = 'EDIT') AS first_edit, min(event_index) FILTER (etype = 'TEST') AS first_test, count(*) FILTER (b <> etype)::BIGINT AS switches, (count(args_hash) - count(DISTINCT args_hash))::BIGINT AS duplicate_calls, count(*) FILTER (etype = 'TOOL_ERROR' AND c > 1)::BIGINT AS retries FROM x GROUP BY 1")
def _(spark, d):
    """Wide feature row of each trace."""
    return sequence.trace_features(tables.events(spark, d))


@query("first_hit_steps", E + "SELECT trace_id, min(event_index) FILTER (etype = 'EDIT') AS first_edit, min(event_index) FILTER (etype = 'TOOL_ERROR') AS first_error FROM e GROUP BY 1")
def _(spark, d):
    """First index of edits and errors."""
    return sequence.first_index(tables.events(spark, d), "trace_id", "event_index", first_edit=F.col("etype") == "EDIT", first_error=F.col("etype") == _err)


@query("type_churn", E + ", x AS (SELECT trace_id, etype <> lag(etype) OVER (PARTITION BY trace_id ORDER BY event_index) AS s FROM e WHERE etype NOT IN ('PLAN', 'OTHER')) SELECT trace_id, count(*) FILTER (s)::BIGINT AS switches FROM x GROUP BY 1")
def _(spark, d):
    """Changes of type."""
    return sequence.type_switches(tables.events(spark, d), "trace_id", "event_index", "etype")


_RUN = ", x AS (SELECT trace_id, event_index, {p} AS p FROM e), y AS (SELECT *, event_index - row_number() OVER (PARTITION BY trace_id, p ORDER BY event_index) AS i FROM x), z AS (SELECT trace_id, i, count(*) AS n FROM y WHERE p GROUP BY 1, 2), t AS (SELECT DISTINCT trace_id FROM e) SELECT trace_id, coalesce(max(n), 0)::BIGINT AS longest FROM t LEFT JOIN z USING (trace_id) GROUP BY 1"


@query("longest_error_run", E + _RUN.format(p="etype = 'TOOL_ERROR'"))
def _(spark, d):
    """Longest run of errors."""
    return sequence.longest_run(tables.events(spark, d), "trace_id", "event_index", F.col("etype") == _err)


@query("no_new_evidence_streak", E + _RUN.format(p="row_number() OVER (PARTITION BY trace_id, args_hash ORDER BY event_index) > 1 AND row_number() OVER (PARTITION BY trace_id, target ORDER BY event_index) > 1"))
def _(spark, d):
    """Longest streak without a new call or a new target."""
    return sequence.no_new_evidence(tables.events(spark, d), "trace_id", "event_index", "args_hash", "target")


@query("novelty_rate", E + "SELECT trace_id, round(count(DISTINCT output_hash) / count(*), 4) AS novel_rate, (count(output_hash) - count(DISTINCT output_hash))::BIGINT AS repeats FROM e GROUP BY 1")
def _(spark, d):
    """Share of new results, and repeats."""
    return sequence.novelty(tables.events(spark, d), "trace_id", "output_hash")


@query("reversions", E + ", x AS (SELECT *, lag(output_hash) OVER (PARTITION BY trace_id ORDER BY event_index) AS b FROM e WHERE output_hash IS NOT NULL) SELECT trace_id, (count(*) - count(DISTINCT output_hash))::BIGINT AS reversions FROM x WHERE b IS NULL OR b <> output_hash GROUP BY 1")
def _(spark, d):
    """Returns to an earlier state."""
    return sequence.reversions(tables.events(spark, d), "trace_id", "event_index", "output_hash")


@query("retry_count", E + ", x AS (SELECT trace_id, etype, count(args_hash) OVER (PARTITION BY trace_id, args_hash) AS n FROM e) SELECT trace_id, count(*) FILTER (etype = 'TOOL_ERROR' AND n > 1)::BIGINT AS retries FROM x GROUP BY 1")
def _(spark, d):
    """Failed calls that were made more than once."""
    return sequence.retries(tables.events(spark, d), "trace_id", "args_hash", F.col("etype") == _err)


@query("re_reads", E + ", x AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id, target ORDER BY event_index) > 1 AS a, max(event_index) OVER (PARTITION BY trace_id, target) > event_index AS l FROM e WHERE etype = 'READ' AND target IS NOT NULL) SELECT trace_id, count(*) FILTER (a)::BIGINT AS re_reads, count(*) FILTER (l)::BIGINT AS read_later FROM x GROUP BY 1")
def _(spark, d):
    """Reads of a target read before or again later."""
    return sequence.reads_again(tables.events(spark, d), "trace_id", "event_index", "target", F.col("etype") == "READ")


@query("search_expansion", E + ", x AS (SELECT trace_id, min(event_index) OVER (PARTITION BY trace_id, target) < event_index AS s FROM e WHERE etype = 'SEARCH') SELECT trace_id, count(*)::BIGINT AS searches, count(*) FILTER (s)::BIGINT AS no_expansion FROM x GROUP BY 1")
def _(spark, d):
    """Searches that find nothing new."""
    return sequence.expansion(tables.events(spark, d), "trace_id", "event_index", "target", F.col("etype") == "SEARCH")


@query("no_evidence_reedit", E + ", x AS (SELECT *, count(*) FILTER (etype IN ('TEST', 'SEARCH', 'READ')) OVER (PARTITION BY trace_id ORDER BY event_index) AS s FROM e), y AS (SELECT trace_id, s = lag(s) OVER (PARTITION BY trace_id, target ORDER BY event_index) AS r FROM x WHERE etype = 'EDIT') SELECT trace_id, count(*)::BIGINT AS edits, count(*) FILTER (r)::BIGINT AS no_evidence_re_edits FROM y GROUP BY 1")
def _(spark, d):
    """Edits again without evidence in between."""
    kind = F.col("etype")
    return sequence.re_edits(tables.events(spark, d), "trace_id", "event_index", "target", kind == "EDIT", kind.isin("TEST", "SEARCH", "READ"))


@query("post_edit_gap", E + ", x AS (SELECT *, max(event_index) FILTER (etype = 'EDIT') OVER (PARTITION BY trace_id) AS l FROM e) SELECT trace_id, max(l) AS last_edit, count(*) FILTER (etype = 'TEST' AND event_index > l)::BIGINT AS tests_after, min(event_index - l) FILTER (etype = 'TEST' AND event_index > l) AS gap FROM x GROUP BY 1")
def _(spark, d):
    """Tests after the last edit."""
    kind = F.col("etype")
    return sequence.post_edit_gap(tables.events(spark, d), "trace_id", "event_index", kind == "EDIT", kind == "TEST").withColumn("tests_after", F.coalesce("tests_after", F.lit(0)))


@query("prefix_k", E + ", x AS (SELECT *, count(*) FILTER (etype NOT IN ('READ')) OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e) SELECT trace_id, event_index, etype FROM x WHERE coalesce(m, 0) < 5")
def _(spark, d):
    """Events up to the fifth meaningful one."""
    return sequence.meaningful_prefix(tables.events(spark, d), "trace_id", "event_index", 5, F.col("etype") != "READ").select("trace_id", "event_index", "etype")


@query("prefix_firewall", E + ", x AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY event_index) AS n FROM e) SELECT trace_id, event_index, etype, args_hash, CAST(NULL AS DOUBLE) AS value FROM x WHERE n <= 10")
def _(spark, d):
    """Ten-event view; values hidden, outputs gone."""
    view = sequence.meaningful_prefix(tables.events(spark, d), "trace_id", "event_index", 10, F.lit(True))
    return sequence.firewall(view, ("value",), ("output_hash", "target")).select("trace_id", "event_index", "etype", "args_hash", "value")


@query("role_pairing", M + ", x AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM m WINDOW w AS (PARTITION BY req_id ORDER BY idx)) SELECT req_id, idx, md5(text) AS action, CASE WHEN r = 'assistant' THEN md5(t) END AS observation FROM x WHERE role = 'user'")
def _(spark, d):
    """Each user turn with the reply right after it."""
    p = sequence.next_pairs(tables.messages(spark, d), "req_id", "idx", "role", "text", "user", "assistant")
    return p.select("req_id", "idx", F.md5("action").alias("action"), F.md5("observation").alias("observation"))


@query("obs_size_quantiles", M + ", s AS (SELECT req_id, list_sort(list(length(text))) AS s, count(*) AS n FROM m WHERE is_obs GROUP BY 1) SELECT req_id, s[(n * 0.5)::DOUBLE::INT + CASE WHEN n * 0.5 < (n * 0.5)::DOUBLE::INT THEN 0 ELSE 1 END]::BIGINT AS median, s[floor(n * 0.9)::INT + 1]::BIGINT AS p90, s[n]::BIGINT AS largest FROM s".replace("(n * 0.5)::DOUBLE::INT + CASE WHEN n * 0.5 < (n * 0.5)::DOUBLE::INT THEN 0 ELSE 1 END", "n // 2 + 1"))
def _(spark, d):
    """Upper median, ninth decile and maximum of observation sizes."""
    return sequence.upper_quantiles(tables.messages(spark, d).where("is_obs"), "req_id", F.length("text"))


_LINES = ", x AS (SELECT req_id, idx, unnest(string_split(text, chr(10))) AS line FROM m), y AS (SELECT req_id, idx, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM x)"


@query("dup_line_fraction", DM + _LINES + ", z AS (SELECT *, min(idx) OVER (PARTITION BY req_id, s) AS f FROM y WHERE length(s) >= 12) SELECT req_id, idx, count(*)::BIGINT AS eligible, count(*) FILTER (f < idx)::BIGINT AS duplicates, round(count(*) FILTER (f < idx) / count(*), 4) AS share FROM z GROUP BY 1, 2")
def _(spark, d):
    """Lines that earlier messages of the request hold."""
    return sequence.duplicate_lines(tables.document_messages(spark, d), "req_id", "idx", "text")


@query("dup_spans", "WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents), y AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM x), z AS (SELECT *, length(s) >= 12 AND row_number() OVER (PARTITION BY doc_id, s ORDER BY no) > 1 AS a FROM y), i AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM z WHERE a), k AS (SELECT doc_id, i, count(*) AS k, sum(no / n) AS p FROM i GROUP BY 1, 2) SELECT doc_id, count(*)::BIGINT AS spans, max(k)::BIGINT AS longest, sum(k)::BIGINT AS duplicates, round(sum(p) / sum(k), 4) AS mean_place FROM k GROUP BY 1")
def _(spark, d):
    """Spans of repeated lines of each document."""
    return sequence.duplicate_spans(tables.read(spark, d, "documents"), "doc_id", "text")


@query("oversized_then_narrow", E + ", x AS (SELECT *, min(value) OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS mn FROM e) SELECT trace_id, count(*)::BIGINT AS oversized, count(*) FILTER (mn < 50)::BIGINT AS narrowed FROM x WHERE value >= 50 GROUP BY 1")
def _(spark, d):
    """Large events with a smaller one soon after."""
    return sequence.oversized_then_narrow(tables.events(spark, d), "trace_id", "event_index", "value", 50.0)


@query("entity_recurrence", E + ", x AS (SELECT *, list(target) OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT trace_id, event_index, coalesce(list_contains(b, target), false) AS recurs FROM x")
def _(spark, d):
    """Does an event's target stand in the last three?"""
    e = tables.events(spark, d)
    return sequence.recurrence(e, "trace_id", "event_index", "target", "target")


# --- votes ------------------------------------------------------------------------
@query("raw_agreement", V + ", u AS (SELECT unit, count(label) AS m, count(DISTINCT label) AS d FROM v GROUP BY 1) SELECT count(*)::BIGINT AS units, count(*) FILTER (d = 1)::BIGINT AS agreed, round(count(*) FILTER (d = 1) / count(*), 4) AS agreement FROM u WHERE m >= 2")
def _(spark, d):
    """Share of units where all raters agree."""
    return agreement.raw_agreement(tables.votes(spark, d))


@query("krippendorff_alpha", V + ", c AS (SELECT unit, label, count(*) AS c FROM v WHERE label IS NOT NULL GROUP BY 1, 2), m AS (SELECT unit, sum(c) AS m FROM c GROUP BY 1 HAVING sum(c) >= 2), k AS (SELECT c.*, m.m FROM c JOIN m USING (unit)), n AS (SELECT sum(t) AS n, sum(t * (t - 1)) AS es FROM (SELECT label, sum(c) AS t FROM k GROUP BY 1)), o AS (SELECT (SELECT sum(c * (c - 1)) FROM k)::DOUBLE AS s, (SELECT sum(m * (m - 1)) FROM m)::DOUBLE AS p), z AS (SELECT 1 - s / p AS ob, 1 - es::DOUBLE / (n * (n - 1)) AS ex FROM o, n) SELECT round(CASE WHEN ex = 0 THEN CASE WHEN ob = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - ob / ex END, 4) AS alpha, round(ob, 4) AS observed, round(ex, 4) AS expected FROM z")
def _(spark, d):
    """Nominal alpha."""
    return agreement.krippendorff(tables.votes(spark, d))


_JAC = V + ", j AS (SELECT a.unit, a.rater AS a, b.rater AS b, len(list_distinct(list_concat(a.labels, b.labels))) AS u, len(list_intersect(a.labels, b.labels)) AS i FROM v a JOIN v b ON a.unit = b.unit AND a.rater < b.rater), jj AS (SELECT unit, a, b, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS jaccard FROM j)"


@query("pairwise_jaccard", _JAC + "SELECT unit, a, b, round(jaccard, 4) AS jaccard FROM jj")
def _(spark, d):
    """Similarity of each two raters' label sets."""
    return agreement.pairwise_jaccard(tables.votes(spark, d))


@query("confusion_pairs", V + "SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*)::BIGINT AS n FROM v a JOIN v b ON a.unit = b.unit AND a.rater < b.rater AND a.label <> b.label GROUP BY 1, 2")
def _(spark, d):
    """Confused primary labels."""
    return agreement.confusion(tables.votes(spark, d))


@query("label_agreement", V + ", k AS (SELECT unit, l.l AS label, count(*) AS k FROM v, unnest(labels) l(l) GROUP BY 1, 2), n AS (SELECT count(DISTINCT unit) AS n FROM v) SELECT label, count(*)::BIGINT AS any_units, count(*) FILTER (k = 3)::BIGINT AS all_units, round((max(n) - count(*) + count(*) FILTER (k = 3)) / max(n), 4) AS agreement FROM k, n GROUP BY 1")
def _(spark, d):
    """Agreement on each label's presence."""
    return agreement.label_agreement(tables.votes(spark, d))


@query("vote_coverage", V + "SELECT rater, count(*)::BIGINT AS votes, count(*) FILTER (label IS NULL)::BIGINT AS abstained, count(*) FILTER (label IN ('OTHER', 'UNKNOWN', 'xx'))::BIGINT AS other, round(avg((len(labels) > 0)::INT), 4) AS coverage FROM v GROUP BY 1")
def _(spark, d):
    """Abstentions and coverage of raters."""
    return agreement.coverage(tables.votes(spark, d))


@query("adjudication_triggers", _JAC + ", f AS (SELECT unit, min(jaccard) AS least FROM jj GROUP BY 1), u AS (SELECT unit, count(*) AS m, count(*) FILTER (label IS NULL) AS ab, count(DISTINCT label) AS d, min(len(labels)) AS br FROM v GROUP BY 1) SELECT unit, concat_ws(',', CASE WHEN ab > 0 THEN 'abstain' END, CASE WHEN d > 1 THEN 'primary' END, CASE WHEN br >= 2 AND least < 0.5 THEN 'sets' END, CASE WHEN m < 2 THEN 'single' END) AS reasons FROM u LEFT JOIN f USING (unit)")
def _(spark, d):
    """Why a unit needs an adjudicator."""
    return agreement.adjudication_triggers(tables.votes(spark, d))


@query("auto_merge", V + ", u AS (SELECT unit, arg_min(label, rater) FILTER (label IS NOT NULL) AS label, count(*) AS m FROM v GROUP BY 1), k AS (SELECT unit, l.l, count(*) AS k FROM v, unnest(labels) l(l) GROUP BY 1, 2), s AS (SELECT k.unit, string_agg(l, ',' ORDER BY l) FILTER (k = m) AS sh, string_agg(l, ',' ORDER BY l) AS ev FROM k JOIN u USING (unit) GROUP BY 1) SELECT unit, label, coalesce(sh, ev, '') AS labels FROM u LEFT JOIN s USING (unit)")
def _(spark, d):
    """Merged votes."""
    return agreement.auto_merge(tables.votes(spark, d))


@query("never_selected", V + "SELECT t.label FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) t(label) WHERE t.label NOT IN (SELECT unnest(labels) FROM v)")
def _(spark, d):
    """Labels that no vote has."""
    return agreement.never_selected(tables.votes(spark, d), spark.createDataFrame([(x,) for x in "ABCDEF"], "label string"))


@query("interesting_tasks", G + "SELECT cluster, count(*) FILTER (baseline)::BIGINT AS solved, count(*) FILTER (candidate)::BIGINT AS kept, CASE WHEN avg(baseline::INT) >= 0.95 THEN 'easy' WHEN avg(baseline::INT) <= 0.05 THEN 'hard' WHEN avg(candidate::INT) < avg(baseline::INT) THEN 'worse' ELSE 'mixed' END AS kind FROM g GROUP BY 1")
def _(spark, d):
    """Classes of clusters by their outcomes."""
    b, c = F.avg(F.col("baseline").cast("int")), F.avg(F.col("candidate").cast("int"))
    return tables.grades(spark, d).groupBy("cluster").agg(F.count_if("baseline").alias("solved"), F.count_if("candidate").alias("kept"), F.when(b >= 0.95, "easy").when(b <= 0.05, "hard").when(c < b, "worse").otherwise("mixed").alias("kind"))


# --- message transforms --------------------------------------------------------------
def _method(name: str, new: str | None, extra: str = "", source: str = DM) -> None:
    """A query of a transform; ``new``: the SQL of an observation's new text."""
    frame = tables.document_messages if source is DM else tables.messages

    def run(spark, d):
        out = messages.apply_method(frame(spark, d), name)
        return out.select("req_id", "idx", F.length("text").alias("chars"), F.md5("text").alias("digest"))

    run.__doc__ = f"M: the {name} transform."
    sql = f"{source}{extra} SELECT req_id, idx, length(nt)::BIGINT AS chars, md5(nt) AS digest FROM (SELECT *, CASE WHEN is_obs THEN {new} ELSE text END AS nt FROM {'x' if extra else 'm'})" if new else None
    query(f"transform_{name.lower()}", sql)(run)


_N = "length(text)"
_NL = "chr(10)"


def _cap_sql(n: int, before: str = "...[", after: str = " chars elided]...") -> str:
    head = int(n * 0.6)
    return f"CASE WHEN {_N} > {n} THEN left(text, {head}) || {_NL} || '{before}' || ({_N} - {n}) || '{after}' || {_NL} || right(text, {n - head}) ELSE text END"


_RANK = ", x AS (SELECT *, row_number() OVER (PARTITION BY req_id, is_obs ORDER BY idx DESC) AS rk, count(*) OVER (PARTITION BY req_id, is_obs) AS no FROM m)"
_clear = lambda w, least=200, a="[earlier observation cleared; ": f"CASE WHEN rk > {w} AND {_N} > {least} THEN '{a}' || {_N} || ' chars]' ELSE text END"
_method("C0_identity", "text")
for _k, _c in (("CAP2K_stable", 2000), ("CAP1K_stable", 1000), ("CAP800_stable", 800), ("CAP500_stable", 500), ("GENTLE4K_stable", 4000), ("GENTLE6K_stable", 6000)):
    _method(_k, _cap_sql(_c))
_method("M3_obs_cap_10k", _cap_sql(10000, "…[", " chars elided; head+tail kept]…"))
_method("M4_obs_cap_5k", _cap_sql(5000, "…[", " chars elided; head+tail kept]…"))
_method("COMP1_tool_compress", f"CASE WHEN {_N} > 2000 THEN left(text, 1000) || {_NL} || '...[' || ({_N} - 1500) || ' chars compressed]...' || {_NL} || right(text, 500) ELSE text END")
_method("NUKE_all_obs", f"CASE WHEN {_N} > 50 THEN '[observation cleared]' ELSE text END")
_method("ERR_ONLY_keep_errors", f"CASE WHEN {_N} > 200 AND NOT ({' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in messages.ERROR_WORDS)}) THEN '[success observation cleared; errors preserved]' ELSE text END")
_method("SUM_ALL_summarize", f"CASE WHEN {_N} > 500 THEN left(text, 150) || '...' || right(text, 80) || ' [' || {_N} || 'c]' ELSE text END")
_method("HALF_context", f"CASE WHEN {_N} > 400 THEN substr(text, {_N} // 2 + 1) ELSE text END")
for _k, _c in (("AGG1_recency_obs_12", 12), ("AGG2_recency_obs_8", 8), ("AGG3_recency_obs_4", 4), ("BRUTAL1_window_2", 2), ("BRUTAL2_window_1", 1)):
    _method(_k, _clear(_c), _RANK)
_method("M7_old_obs_elide", _clear(8, 300, "[earlier tool observation cleared (context editing); "), _RANK)
_method("SUM1_summarize_old", f"CASE WHEN rk > 6 AND {_N} > 300 THEN left(text, 100) || '...' || right(text, 50) || ' [' || {_N} || ' chars total]' ELSE text END", _RANK)
_method("HYBRID1_m7_agg2", f"CASE WHEN no > 12 AND rk > 12 AND {_N} > 200 THEN '[old observation cleared; ' || {_N} || ' chars]' WHEN no > 12 AND rk > 8 AND {_N} > 200 THEN left(text, 100) || '...' || right(text, 50) || ' [' || {_N} || 'c]' ELSE text END", _RANK)
_method("PROG1_progressive", f"CASE WHEN rk <= 4 OR {_N} <= 200 THEN text WHEN rk > 12 THEN left(text, 80) || '... [' || {_N} || 'c total, old]' WHEN rk > 8 AND {_N} > 500 THEN left(text, 250) || '...[' || {_N} || 'c]...' || right(text, 100) WHEN rk <= 8 AND {_N} > 2000 THEN left(text, 1000) || {_NL} || '...[compressed]...' || {_NL} || right(text, 500) ELSE text END", _RANK)
_FIRST = f", x AS (SELECT *, min(CASE WHEN is_obs AND {_N} >= 200 THEN idx END) OVER (PARTITION BY req_id, text) AS f FROM m)"
_method("M1_dedup_exact", f"CASE WHEN {_N} >= 200 AND f < idx THEN '[identical to the observation at step ' || f || ']' ELSE text END", _FIRST)
_method("DEDUPS_stable", f"CASE WHEN {_N} >= 200 AND f < idx THEN '[identical to earlier observation #' || f || '; ' || {_N} || ' chars]' ELSE text END", _FIRST)
_SQ = "regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_method("SQUEEZE_e4", f"CASE WHEN {_N} >= 200 AND length({_SQ}) < {_N} THEN {_SQ} ELSE text END")
_LS = "string_split(text, chr(10))"
_method("RETRIEVREF_e4", f"CASE WHEN {_N} <= 5000 THEN text WHEN len({_LS}) < 50 THEN left(text, 3000) || {_NL} || '[... ' || ({_N} - 3500) || ' chars elided; re-run the command to see full output ...]' || {_NL} || right(text, 500) ELSE array_to_string({_LS}[1:30], {_NL}) || {_NL} || '[... ' || (len({_LS}) - 45) || ' lines elided (' || {_N} || ' chars total); re-read file/re-run to see full ...]' || {_NL} || array_to_string({_LS}[-15:], {_NL}) END")
_LD = ", el AS (SELECT req_id, idx, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM m WHERE is_obs), es AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM el), ed AS (SELECT *, length(s) >= 12 AND row_number() OVER (PARTITION BY req_id, s ORDER BY idx, no) > 1 AS dr FROM es), ek AS (SELECT req_id, idx, string_agg(line, chr(10) ORDER BY no) FILTER (NOT dr) AS kept, count(*) FILTER (dr) AS dropped FROM ed GROUP BY 1, 2), x AS (SELECT m.*, coalesce(kept, '') AS kept, dropped FROM m LEFT JOIN ek USING (req_id, idx))"
_method("LINEDEDUP_e4", f"CASE WHEN {_N} >= 300 AND dropped > 3 THEN kept || {_NL} || '[' || dropped || ' duplicate lines elided]' ELSE text END", _LD)
_TURNS = ", x AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY idx) AS place, count(*) OVER (PARTITION BY req_id) AS turns FROM m)"
_method("CNEG_recency", "CASE WHEN turns > 8 AND place > 2 AND place <= turns - 6 AND role = 'user' THEN '[earlier turn dropped by recency window]' ELSE text END", _TURNS)
_PREV = ", x AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY req_id ORDER BY idx), '') AS prev FROM m)"
_HEAD = "regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\r\\n|\\n|\\r')"
_method("M5_search_head", f"CASE WHEN regexp_matches(prev, '{messages.SEARCH_COMMAND}') AND len({_HEAD}) > 25 THEN array_to_string({_HEAD}[1:20], {_NL}) || {_NL} || '…[' || (len({_HEAD}) - 20) || ' more result lines elided]' ELSE text END", _PREV)
_has = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_method("M6_env_log_collapse", f"CASE WHEN regexp_matches(prev, '{messages.BUILD_COMMAND}') AND {_N} >= 400 AND NOT {_has('lower(text)', messages.BUILD_FAILURES)} THEN '[build/env step succeeded; ' || {_N} || ' chars of log elided]' ELSE text END", _PREV)
_READ = _PREV.replace("x AS", "x0 AS") + f", x1 AS (SELECT *, CASE WHEN is_obs THEN nullif(regexp_extract(prev, '{messages.READ_PATH}', 1), '') END AS p FROM x0), x AS (SELECT *, max(idx) OVER (PARTITION BY req_id, p) AS later FROM x1)"
_method("M2_stale_read_elide", f"CASE WHEN p IS NOT NULL AND later > idx AND {_N} > 200 THEN '[stale view of ' || p || '; superseded by a later read/edit at step ' || later || ']' ELSE text END", _READ)


def _then(new: str, before: str = "", source: str = "m") -> str:
    """SQL of the messages after a first transform, as table ``y``."""
    return f"{before}, y AS (SELECT req_id, idx, is_obs, role, CASE WHEN is_obs THEN {new} ELSE text END AS text FROM {source})"


_OLD = _then(_clear(8, 300, "[earlier tool observation cleared (context editing); "), _RANK, "x").replace("x AS (", "x2 AS (").replace("FROM x)", "FROM x2)")
_FIRST_Y = _FIRST.replace("FROM m)", "FROM y)")
_SMART = lambda least, few, block, head, errors, tail, marks, mid: (
    f"CASE WHEN {_N} <= {least} THEN text WHEN len({_LS}) <= {few} THEN {block} WHEN length(array_to_string(list_concat({_LS}[1:{head}], {mid}, list_filter({_LS}, lambda z: {_has('z', marks)})[1:{errors}], {_LS}[-{tail}:]), {_NL})) < {_N}"
    f" THEN array_to_string(list_concat({_LS}[1:{head}], {mid}, list_filter({_LS}, lambda z: {_has('z', marks)})[1:{errors}], {_LS}[-{tail}:]), {_NL}) ELSE text END"
)
_SM = _SMART(600, 12, f"CASE WHEN {_N} > 1200 THEN left(text, 700) || {_NL} || '...[' || ({_N} - 1000) || ' elided]...' || {_NL} || right(text, 300) ELSE text END", 6, 8, 4, messages.SMART_MARKS, f"CASE WHEN len({_LS}) > 10 THEN ['...[middle elided]...'] ELSE [] END")
_SG = _SMART(3000, 20, f"left(text, 1800) || {_NL} || '...[' || ({_N} - 2400) || ' elided]...' || {_NL} || right(text, 600)", 12, 10, 6, messages.GENTLE_MARKS, "['...[middle elided]...']")
_method("COMBO1_m7_cap5k", _cap_sql(5000, "…[", " chars elided; head+tail kept]…"), _OLD + ", x AS (SELECT * FROM y)")
_method("COMBO2_m7_dedup", f"CASE WHEN {_N} >= 200 AND f < idx THEN '[identical to the observation at step ' || f || ']' ELSE text END", _OLD + _FIRST_Y)
_method("COMBOCD_stable", _cap_sql(1000), _then(f"CASE WHEN {_N} >= 200 AND f < idx THEN '[identical to earlier observation #' || f || '; ' || {_N} || ' chars]' ELSE text END", _FIRST.replace("x AS", "x0 AS"), "x0") + ", x AS (SELECT * FROM y)")
_method("SMART_stable", _SM)
_method("COMBOSC_stable", _cap_sql(1200), _then(_SM) + ", x AS (SELECT * FROM y)")
_method("SMARTGENTLE_stable", _SG)


def _signal_sql(source: str) -> str:
    """Lines by kind: signal, other, blank; a blank one is dropped after a dropped one."""
    return f""", sl AS (SELECT req_id, idx, generate_subscripts({_LS}, 1) AS no, unnest({_LS}) AS line FROM {source} WHERE is_obs AND {_N} > 2000 AND len({_LS}) >= 20),
 sk AS (SELECT *, CASE WHEN regexp_matches(line, '{messages.SIGNAL}') THEN 'S' WHEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' THEN 'N' END AS kind FROM sl),
 sd AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY req_id, idx ORDER BY no), 'S') = 'N' AS gone FROM sk),
 se AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY req_id, idx ORDER BY no), false) AS after FROM sd),
 sg AS (SELECT req_id, idx, coalesce(string_agg(CASE WHEN gone THEN '  ...' ELSE line END, chr(10) ORDER BY no) FILTER (NOT (gone AND after)), '') AS short FROM se GROUP BY 1, 2),
 x AS (SELECT s.*, short FROM {source} s LEFT JOIN sg USING (req_id, idx))"""


_SIGNAL = f"CASE WHEN length(short) < {_N} * 0.85 THEN short ELSE text END"
_method("SIGNAL_e4", _SIGNAL, _signal_sql("m"))
_method("COMBOSS_e4", _SIGNAL, _then(f"CASE WHEN {_N} >= 200 AND length({_SQ}) < {_N} THEN {_SQ} ELSE text END") + _signal_sql("y"))
for _k in messages.METHODS:
    if f"transform_{_k.lower()}" not in QUERIES:
        _method(_k, None)


@query("transform_report", DM + f", x AS (SELECT req_id, idx, text, CASE WHEN is_obs THEN {_cap_sql(500)} ELSE text END AS nt FROM m) SELECT req_id, sum(length(text))::BIGINT AS chars_before, sum(length(nt))::BIGINT AS chars_after, count(*) FILTER (text <> nt)::BIGINT AS changed, min(idx) FILTER (text <> nt) AS first_changed, floor((sum(length(text)) - sum(length(nt))) / 4)::BIGINT AS tokens_saved FROM x GROUP BY 1")
def _(spark, d):
    """What a transform changed, by request."""
    m = tables.document_messages(spark, d)
    return messages.change_report(m, messages.apply_method(m, "CAP500_stable"))


# --- statistics ------------------------------------------------------------------------
@query("diff_in_means", G + "SELECT stratum, round(avg(y) FILTER (a = 1), 4) AS mean_1, round(avg(y) FILTER (a = 0), 4) AS mean_0, round(avg(y) FILTER (a = 1) - avg(y) FILTER (a = 0), 4) AS diff, count(*) FILTER (a = 1)::BIGINT AS n_1, count(*) FILTER (a = 0)::BIGINT AS n_0 FROM g GROUP BY 1")
def _(spark, d):
    """Difference in means by stratum."""
    return statistics.difference_in_means(tables.trial(spark, d), "stratum")


@query("block_adjusted_ate", G + ", b AS (SELECT cluster, avg(y) FILTER (a = 1) - avg(y) FILTER (a = 0) AS d, count(*) AS n FROM g GROUP BY 1 HAVING count(*) FILTER (a = 1) > 0 AND count(*) FILTER (a = 0) > 0) SELECT round(sum(d * n) / sum(n), 4) AS ate, sum(n)::BIGINT AS n, count(*)::BIGINT AS blocks FROM b")
def _(spark, d):
    """Within-block effect weighted by block size."""
    return statistics.block_adjusted(tables.trial(spark, d), "cluster")


_W2 = lambda k, n, s: f"(({k} / {n} + 1.96 * 1.96 / 2 / {n} {s} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / 4 / ({n} * {n}))) / (1 + 1.96 * 1.96 / {n}))"


@query("newcombe_ni", G + f", c AS (SELECT count(*) FILTER (a = 1 AND y < 2000)::DOUBLE AS k1, count(*) FILTER (a = 1)::DOUBLE AS n1, count(*) FILTER (a = 0 AND y < 2000)::DOUBLE AS k0, count(*) FILTER (a = 0)::DOUBLE AS n0 FROM g), w AS (SELECT *, {_W2('k1', 'n1', '-')} AS l1, {_W2('k1', 'n1', '+')} AS u1, {_W2('k0', 'n0', '-')} AS l0, {_W2('k0', 'n0', '+')} AS u0 FROM c), z AS (SELECT k1 / n1 - k0 / n0 AS diff, k1 / n1 - k0 / n0 - sqrt((k1 / n1 - l1) ** 2 + (u0 - k0 / n0) ** 2) AS low, k1 / n1 - k0 / n0 + sqrt((u1 - k1 / n1) ** 2 + (k0 / n0 - l0) ** 2) AS high FROM w) SELECT round(diff, 4) AS diff, round(low, 4) AS low, round(high, 4) AS high, low > -0.15 AS non_inferior FROM z")
def _(spark, d):
    """Newcombe interval and non-inferiority."""
    return statistics.newcombe(tables.trial(spark, d), F.col("y") < 2000, -0.15)


@query("hajek_ipw", G + ", p AS (SELECT 'never' AS policy, *, 0 AS arm FROM g UNION ALL SELECT 'always', *, 1 FROM g UNION ALL SELECT 'signal', *, CASE WHEN stratum = 'HIGH' THEN 1 ELSE 0 END FROM g) SELECT policy, round(sum(CASE WHEN a = arm THEN 2 * y ELSE 0 END) / sum(CASE WHEN a = arm THEN 2 ELSE 0 END), 4) AS hajek, round(sum(CASE WHEN a = arm THEN 2 * y ELSE 0 END) / count(*), 4) AS ipw FROM p GROUP BY 1")
def _(spark, d):
    """Values of policies by inverse propensity."""
    arms = {"never": F.lit(0), "always": F.lit(1), "signal": (F.col("stratum") == "HIGH").cast("int")}
    return statistics.hajek(tables.trial(spark, d), arms)


@query("leave_one_cluster_out", G + ", c AS (SELECT DISTINCT cluster FROM g) SELECT c.cluster, round(avg(y) FILTER (a = 1) - avg(y) FILTER (a = 0), 4) AS diff FROM c JOIN g ON g.cluster <> c.cluster GROUP BY 1 HAVING count(*) FILTER (a = 1) > 0 AND count(*) FILTER (a = 0) > 0")
def _(spark, d):
    """Effect without each cluster, from totals."""
    return statistics.leave_one_out(tables.trial(spark, d), "cluster")


@query("loro_dr", G + """, st AS (SELECT DISTINCT stratum FROM g), ar AS (SELECT DISTINCT a AS arm FROM g), cl AS (SELECT DISTINCT cluster FROM g), mu AS (SELECT cl.cluster, st.stratum, ar.arm, coalesce(avg(g.y) FILTER (g.a = ar.arm AND g.stratum = st.stratum), avg(g.y) FILTER (g.a = ar.arm), avg(g.y)) AS mu FROM cl, st, ar LEFT JOIN g ON g.cluster <> cl.cluster GROUP BY 1, 2, 3)
 SELECT mu.arm::BIGINT AS arm, round(avg(mu + CASE WHEN a = mu.arm THEN (y - mu) / 0.5 ELSE 0 END), 4) AS value, count(*)::BIGINT AS n FROM g JOIN mu USING (cluster, stratum) GROUP BY 1""")
def _(spark, d):
    """Doubly robust arm values, means from other clusters."""
    return statistics.cross_fit(tables.trial(spark, d))


@query("spearman_ordinal", G + ", r AS (SELECT row_number() OVER (ORDER BY y, task_id) AS rx, row_number() OVER (ORDER BY moderator, task_id) AS ry FROM g) SELECT round(1 - 6 * sum((rx - ry)::DOUBLE * (rx - ry)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 4) AS rho, count(*)::BIGINT AS n FROM r")
def _(spark, d):
    """Spearman correlation with ordinal ties."""
    return statistics.spearman(tables.trial(spark, d), "y", "moderator", "unit")


@query("spearman_within", G + ", r AS (SELECT cluster, rank() OVER (PARTITION BY cluster ORDER BY y) + (count(*) OVER (PARTITION BY cluster, y) - 1) / 2 AS rx, rank() OVER (PARTITION BY cluster ORDER BY moderator) + (count(*) OVER (PARTITION BY cluster, moderator) - 1) / 2 AS ry FROM g) SELECT cluster, round(corr(rx, ry), 4) AS rho, count(*)::BIGINT AS n FROM r GROUP BY 1")
def _(spark, d):
    """Spearman correlation inside each cluster."""
    return statistics.spearman_within(tables.trial(spark, d), "cluster", "y", "moderator")


@query("bh_adjust", G + ", p AS (SELECT cluster, abs(sin(count(*))) AS p FROM g GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, cluster) AS r, count(*) OVER () AS m FROM p) SELECT cluster, round(p, 4) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS q FROM r")
def _(spark, d):
    """Adjusted p-values of a family of tests."""
    p = tables.grades(spark, d).groupBy("cluster").agg(F.abs(F.sin(F.count(F.lit(1)))).alias("p"))
    return statistics.benjamini_hochberg(p, "cluster", "p")


@query("moments", G + "SELECT stratum, round(sum(pow(y - m, 3)) / count(*) / pow(stddev_pop(y), 3), 4) AS skewness, round(kurtosis_pop(y), 4) AS kurtosis, round(stddev_samp(y) / avg(y), 4) AS cv, round(max(y) / median(y), 4) AS max_over_median, round(stddev_pop(y), 4) AS sd, round(stddev_samp(y), 4) AS sd_sample FROM (SELECT *, avg(y) OVER (PARTITION BY stratum) AS m FROM g) GROUP BY 1")
def _(spark, d):
    """A5: tails of the outcome."""
    return statistics.moments(tables.trial(spark, d), "stratum")


@query("auroc", G + ", r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS r, a FROM g) SELECT round((sum(r) FILTER (a = 1) - count(*) FILTER (a = 1) * (count(*) FILTER (a = 1) + 1) / 2) / (count(*) FILTER (a = 1) * count(*) FILTER (a = 0)), 4) AS auroc, count(*) FILTER (a = 1)::BIGINT AS positives, count(*) FILTER (a = 0)::BIGINT AS negatives FROM r")
def _(spark, d):
    """Area under the ROC curve by rank sums."""
    return statistics.auroc(tables.trial(spark, d), "y", F.col("a") == 1)


@query("cluster_bootstrap", G + """, c AS (SELECT cluster, sum(y) FILTER (a = 0) AS s0, count(y) FILTER (a = 0) AS n0, sum(y) FILTER (a = 1) AS s1, count(y) FILTER (a = 1) AS n1 FROM g GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY cluster NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM c),
d AS (SELECT k.draw, floor(('0x' || substr(sha256('0|' || k.draw || '|' || i.idx), 1, 8))::BIGINT / 4294967296.0 * i.n)::BIGINT AS pick FROM i, (SELECT unnest(range(200)) AS draw) k),
s AS (SELECT draw, sum(s1) AS s1, sum(n1) AS n1, sum(s0) AS s0, sum(n0) AS n0 FROM d JOIN i ON pick = idx GROUP BY 1)
SELECT round(quantile_cont(s1 / n1 - s0 / n0, 0.025), 4) AS low, round(quantile_cont(s1 / n1 - s0 / n0, 0.975), 4) AS high, count(*)::BIGINT AS draws FROM s WHERE n0 > 0 AND n1 > 0""")
def _(spark, d):
    """Cluster bootstrap interval; draws are hashes."""
    return statistics.cluster_bootstrap(tables.trial(spark, d), 200)


@query("block_permutation", G + """, s AS (SELECT task_id AS unit, cluster, a, y, sum(a) OVER (PARTITION BY cluster) AS k FROM g), d AS (SELECT s.*, r.draw FROM s, (SELECT unnest(range(101)) AS draw) r),
o AS (SELECT *, row_number() OVER (PARTITION BY draw, cluster ORDER BY ('0x' || substr(sha256('0|' || draw || '|' || unit), 1, 8))::BIGINT, unit) AS n FROM d),
m AS (SELECT draw, cluster, CASE WHEN draw = 0 THEN a ELSE (n <= k)::INT END AS a, y FROM o), c AS (SELECT draw, cluster, avg(y) FILTER (a = 1) AS m1, avg(y) FILTER (a = 0) AS m0, count(*) AS n FROM m GROUP BY 1, 2),
t AS (SELECT draw, sum((m1 - m0) * n) / sum(n) AS t FROM c WHERE m1 IS NOT NULL AND m0 IS NOT NULL GROUP BY 1), z AS (SELECT *, max(t) FILTER (draw = 0) OVER () AS seen FROM t)
SELECT round((count(*) FILTER (abs(t) >= abs(seen) - 1e-12) + 1) / (count(*) + 1), 4) AS p, round(max(seen), 4) AS ate, count(*)::BIGINT AS draws FROM z WHERE draw > 0""")
def _(spark, d):
    """Block permutation p-value; draws are hashes."""
    return statistics.block_permutation(tables.trial(spark, d), "cluster", 100)


@query("ols_slope", G + "SELECT 'a' AS term, round(regr_slope(y, a), 4) AS coef, count(*)::BIGINT AS n FROM g")
def _(spark, d):
    """Least squares against the closed form."""
    return statistics.ols(tables.trial(spark, d), "y", ["a"], "cluster").where("term = 'a'").select("term", "coef", "n")


@query("ols_robust")
def _(spark, d):
    """Interaction model with robust errors (rows only)."""
    t = tables.trial(spark, d).withColumn("ax", F.col("a") * F.col("moderator"))
    return statistics.ols(t, "y", ["a", "moderator", "ax"], "cluster")


# --- studies ---------------------------------------------------------------------------
_GRID = (5000.0, 20000.0, 50000.0, 100000.0)


@query("loro_threshold", L + ", q AS (SELECT *, task_id % 11 AS grp FROM p WHERE method = 'A'), c AS (SELECT grp, t.t, sum(CASE WHEN base >= t.t THEN cost ELSE base END) AS c, sum(base) AS keep, sum(cost) AS alw FROM q, (VALUES (5000.0), (20000.0), (50000.0), (100000.0)) t(t) GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY t) - c AS rest FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rest, t) AS rn FROM r) SELECT grp, t::DOUBLE AS threshold, round(c, 4) AS policy, round(keep, 4) AS keep, round(alw, 4) AS always FROM k WHERE rn = 1")
def _(spark, d):
    """Threshold chosen on the other groups."""
    pairs = _pairs(spark, d).where("method = 'A'").withColumn("grp", F.col("task_id") % 11)
    return studies.held_out_threshold(pairs, "grp", "base", _GRID)


@query("feasible_oracle", L + ", b AS (SELECT task_id, arg_min(method, cost) AS method, min(cost) AS cost FROM t WHERE changed_calls > 0 GROUP BY 1) SELECT n.task_id, round(n.cost, 4) AS base, CASE WHEN b.cost < 0.95 * n.cost THEN b.method ELSE 'N' END AS method, round(CASE WHEN b.cost < 0.95 * n.cost THEN b.cost ELSE n.cost END, 4) AS cost FROM t n LEFT JOIN b USING (task_id) WHERE n.method = 'N'")
def _(spark, d):
    """Cheapest feasible method under a tolerance."""
    costs = ledger.task_cost(tables.with_cost(tables.ledger(spark, d)))
    return studies.feasible_oracle(costs, F.col("changed_calls") > 0, 0.05, tables.BASELINE)


@query("risk_selector", E + ", f AS (SELECT trace_id, count(*) AS n, count(*) FILTER (etype = 'SEARCH') / count(*) AS s, count(*) FILTER (etype = 'EDIT') / count(*) AS c, count(*) FILTER (etype = 'TEST') = 0 AS u FROM e GROUP BY 1) SELECT trace_id, CASE WHEN s >= 0.35 THEN 'SEARCH_CONSTRAINED' WHEN c >= 0.3 THEN 'PATCH_GUARD' WHEN u THEN 'VERIFY_HEAVY' ELSE 'DEFAULT' END AS config FROM f")
def _(spark, d):
    """Configuration by thresholds of a risk level."""
    f = sequence.trace_features(tables.events(spark, d))
    return f.select("trace_id", studies.select_config(F.col("searches") / F.col("n_events"), F.col("edits") / F.col("n_events"), F.col("tests") == 0, "HIGH").alias("config"))


@query("calibration_bins", G + ", b AS (SELECT ntile(3) OVER (ORDER BY moderator, task_id) AS bin, moderator, y FROM g) SELECT bin::BIGINT AS bin, round(avg(moderator), 4) AS predicted, round(avg(y), 4) AS actual, count(*)::BIGINT AS n FROM b GROUP BY 1")
def _(spark, d):
    """Outcome by thirds of the prediction."""
    return studies.calibration(tables.trial(spark, d), "moderator", "y", "unit")


@query("coverage_curve", G + "SELECT t.t::DOUBLE AS cut, round(count(*) FILTER (moderator >= t.t) / count(*), 4) AS coverage, round(avg(y) FILTER (moderator >= t.t), 4) AS gain FROM g, (VALUES (0.0), (0.25), (0.5), (0.75)) t(t) GROUP BY 1")
def _(spark, d):
    """Share and gain above each cut."""
    return studies.coverage_curve(tables.trial(spark, d), "moderator", "y", (0.0, 0.25, 0.5, 0.75))


@query("imputed", "WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer), m AS (SELECT median(v) AS m FROM x) SELECT c_custkey, round(coalesce(v, m), 4) AS v, v IS NULL AS miss_v FROM x, m")
def _(spark, d):
    """Medians for missing values, and flags."""
    c = tables.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return studies.impute(c, ["v"]).select("c_custkey", "v", "miss_v")


@query("shard_sizes", "WITH s AS (SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 12 AS shard FROM supplier) SELECT shard, count(*)::BIGINT AS n FROM s GROUP BY 1")
def _(spark, d):
    """K6: rows of each shard of twelve."""
    return studies.shards(tables.read(spark, d, "supplier"), "s_suppkey").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("oof_ridge")
def _(spark, d):
    """Out-of-fold ridge predictions by cluster (tested against numpy)."""
    t = tables.trial(spark, d).withColumn("s", (F.col("stratum") == "HIGH").cast("double"))
    return studies.out_of_fold_ridge(t, "cluster", "unit", "y", ["moderator", "s", "a"])


@query("placebo_moderator")
def _(spark, d):
    """The moderator among hash-drawn placebos (rows only)."""
    return studies.placebo(tables.trial(spark, d), 50)


@query("null_noise_gap")
def _(spark, d):
    """Gap made by noise alone (simulation; rows only)."""
    import numpy as np

    return studies.null_gap(spark, np.linspace(1, 5, 50), 0.46, draws=100)


@query("power_simulation")
def _(spark, d):
    """Power of a balanced trial (simulation; rows only)."""
    return studies.power(spark, 200, 0.3, 1.0, draws=100)


@query("name_clusters")
def _(spark, d):
    """Greedy clusters of names (order-dependent; rows only)."""
    p = tables.read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("family"), F.col("n_nationkey").cast("long").alias("position"), F.col("n_name").alias("name"), F.lit("").alias("definition"), F.lit("one").alias("coder"))
    return studies.cluster_names(p).groupBy("family").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("names"))


# --- text scalars ------------------------------------------------------------------------
@query("error_markers", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{m.split(':')[0].split('>')[0].strip()}'" for m in C.ERROR_MARKERS) + " END AS marker, CASE WHEN text IS NULL THEN NULL WHEN (contains(lower(text), 'passed') OR regexp_matches(lower(text), '\\bok\\b')) AND (contains(lower(text), 'failed') OR contains(lower(text), 'error')) THEN 'MIXED' WHEN contains(lower(text), 'failed') OR contains(lower(text), 'error') THEN 'FAIL' WHEN contains(lower(text), 'passed') OR regexp_matches(lower(text), '\\bok\\b') THEN 'PASS' ELSE 'UNKNOWN' END AS result FROM documents")
def _(spark, d):
    """Error markers and test results of texts."""
    return tables.read(spark, d, "documents").select("doc_id", C.error_marker(F.col("text")).alias("marker"), C.test_result(F.col("text")).alias("result"))


@query("content_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))::BIGINT AS chars FROM documents")
def _(spark, d):
    """Hashes and normalised lengths."""
    return tables.read(spark, d, "documents").select("doc_id", C.content_hash(F.col("text")).alias("sha"), F.length(C.normalize_space(F.col("text"))).alias("chars"))


@query("query_signatures", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(text, '(?i)^\\s*(grep|rg|ag|find|search_file|search_dir|find_file|git grep|egrep|fgrep)\\b', '')), '[a-z_][a-z0-9_]{2,}'))), ',') AS signature FROM benchmark")
def _(spark, d):
    """Sorted distinct names of a query."""
    return tables.read(spark, d, "benchmark").select("item_id", F.array_join(C.query_signature(F.col("text")), ",").alias("signature"))


@query("paths_in_pages", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '(?:\\.?/)?(?:[\\w.\\-]+/){1,}[\\w.\\-]+\\.\\w{1,6}'))), ',') AS paths FROM pages")
def _(spark, d):
    """P5: file paths in addresses, sorted."""
    return tables.read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(C.paths(F.col("url"))), ",").alias("paths"))
