"""Queries on segments, observations and requests, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import sequence
from ..sources import sinks, tables
from ..streaming import requests
from .catalog import DM, E, M, query

_SCAN = f"""
SELECT doc_id,
 len(list_distinct(regexp_extract_all(t, '{ev.PATHS}')))::BIGINT AS n_paths,
 len(list_distinct(regexp_extract_all(t, '{ev.FUNCTIONS}', 1)))::BIGINT AS n_funcs,
 len(list_distinct(regexp_extract_all(t, '{ev.CLASSES}', 1)))::BIGINT AS n_classes,
 len(regexp_extract_all(t, '{ev.ERRORS}'))::BIGINT AS n_errors,
 len(regexp_extract_all(t, '{ev.TRACEBACK_LINES}'))::BIGINT AS n_traceback_lines,
 len(list_distinct(regexp_extract_all(t, '{ev.TESTS}')))::BIGINT AS n_tests,
 len(regexp_extract_all(t, '{ev.SHELL}'))::BIGINT AS n_shell,
 regexp_matches(t, '{ev.TRANSIENT}') AS transient_state, length(t)::BIGINT AS n_chars,
 len(regexp_extract_all(t, '{ev.PATHS}')) > 0 AND len(regexp_extract_all(t, '{ev.ERRORS}')) = 0 AS looks_like_file_read,
 len(regexp_extract_all(t, '{ev.TESTS}')) > 0 OR len(regexp_extract_all(t, '{ev.TRACEBACK_LINES}')) > 0 AS looks_like_test_output
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query("segment_scanners", _SCAN)
def _(spark, d):
    """What each segment names, and what it looks like."""
    return ev.scan(tables.read(spark, d, "documents"), "text", "doc_id")


@query("edit_outcomes", M + f"""
SELECT CASE WHEN regexp_matches(text, '{ev.EDIT_FAILED}') THEN 'failed' WHEN length(text) > 0 THEN 'applied' END AS outcome, count(*)::BIGINT AS n
FROM m WHERE is_obs GROUP BY 1""")
def _(spark, d):
    """Edits that failed and that were applied, by what the editor says."""
    m = tables.messages(spark, d).where("is_obs")
    return m.groupBy(ev.edit_outcome(F.col("text")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("call_classes", M + """
SELECT req_id, count(*)::BIGINT AS n_messages,
 CASE WHEN count(*) <= 2 OR count(*) FILTER (role = 'assistant') = 0 THEN 'internal_setup' ELSE 'main_agent_call' END AS call_class
FROM m GROUP BY 1""")
def _(spark, d):
    """The class of each request's call."""
    return ev.call_kind(tables.messages(spark, d), "req_id", "role")


@query("phases", M + f"""
SELECT req_id, CASE WHEN bool_or(contains(text, 'diff --git') OR contains(text, '+++ b/')) THEN 'implementation_or_verification'
 WHEN bool_or(is_obs AND regexp_matches(text, '{ev.TESTS}')) THEN 'diagnosis_with_tests' ELSE 'early_diagnosis' END AS phase
FROM m GROUP BY 1""")
def _(spark, d):
    """The phase that each request's messages tell of."""
    text = F.col("text")
    has_patch = F.bool_or(text.contains(ev.PATCH_MARKS[0]) | text.contains(ev.PATCH_MARKS[1]))
    return tables.messages(spark, d).groupBy("req_id").agg(ev.phase(has_patch, F.bool_or(F.col("is_obs") & text.rlike(ev.TESTS))).alias("phase"))


_COUNTS = E + """,
f AS (SELECT trace_id, count(*) FILTER (etype = 'SEARCH') AS s, count(*) FILTER (etype = 'EDIT') AS e, count(*) FILTER (etype = 'TEST') AS t,
 count(*) FILTER (etype = 'TOOL_ERROR') / count(*) AS er, count(*) AS n, sum(value) AS v FROM e GROUP BY 1)"""


def _counts(spark, d):
    kind = lambda k: F.count_if(F.col("etype") == k)
    n = F.count(F.lit(1))
    return tables.events(spark, d).groupBy("trace_id").agg(kind("SEARCH").alias("s"), kind("EDIT").alias("e"), kind("TEST").alias("t"), (kind("TOOL_ERROR") / n).alias("er"), n.alias("n"), F.sum("value").alias("v"))


@query("behaviour", _COUNTS + """
SELECT trace_id, CASE WHEN greatest(s, e, t) = 0 THEN 'other' WHEN s = greatest(s, e, t) THEN 'search_heavy' WHEN e = greatest(s, e, t) THEN 'edit_heavy' ELSE 'test_heavy' END AS mix,
 CASE WHEN x = '' THEN 'generic' ELSE x END AS axes
FROM (SELECT *, concat_ws(',', CASE WHEN s >= 5 THEN 'search_heavy' END, CASE WHEN e >= 5 THEN 'edit_heavy' END, CASE WHEN t >= 2 THEN 'test_heavy' END,
 CASE WHEN er >= 0.15 THEN 'high_error' WHEN er = 0 THEN 'low_error' END, CASE WHEN n <= 8 THEN 'short_traj' WHEN n >= 40 THEN 'long_traj' END) AS x FROM f)""")
def _(spark, d):
    """The dominant behaviour of each trace and all axes it is on."""
    c = F.col
    f = _counts(spark, d)
    return f.select("trace_id", ev.behaviour_mix(c("s"), c("e"), c("t")).alias("mix"), F.array_join(ev.behaviour_axes(c("s"), c("e"), c("t"), c("er"), c("n")), ",").alias("axes"))


@query("stratum_keys", _COUNTS + """
SELECT CASE WHEN n % 3 = 0 THEN 'UNKNOWN' WHEN n % 3 = 1 THEN 'SOLVED' ELSE 'UNSOLVED' END AS outcome,
 CASE WHEN v <= 400 THEN 'low' WHEN v >= 900 THEN 'high' ELSE 'med' END AS tokens, CASE WHEN n <= 8 THEN 'low' WHEN n >= 14 THEN 'high' ELSE 'med' END AS length,
 CASE WHEN greatest(s, e, t) = 0 THEN 'other' WHEN s = greatest(s, e, t) THEN 'search_heavy' WHEN e = greatest(s, e, t) THEN 'edit_heavy' ELSE 'test_heavy' END AS mix,
 CASE WHEN er > 0.1 THEN 'errhi' ELSE 'errlo' END AS errors, count(*)::BIGINT AS traces
FROM f GROUP BY ALL""")
def _(spark, d):
    """Traces by outcome, size, length, behaviour and errors."""
    from ..functions.columns import tertile

    c = F.col
    outcome = ev.outcome_label(F.when(c("n") % 3 != 0, c("n") % 3 == 1))
    keys = (outcome.alias("outcome"), tertile(c("v"), F.lit(400), F.lit(900)).alias("tokens"), tertile(c("n"), F.lit(8), F.lit(14)).alias("length"), ev.behaviour_mix(c("s"), c("e"), c("t")).alias("mix"), F.when(c("er") > 0.1, "errhi").otherwise("errlo").alias("errors"))
    return _counts(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("traces"))


_REDUNDANT = DM + r""",
ln AS (SELECT req_id, idx, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM m WHERE is_obs),
sn AS (SELECT req_id, idx, min(idx) OVER (PARTITION BY req_id, line) < idx AS old FROM ln WHERE length(line) >= 12),
ct AS (SELECT req_id, idx, count(*) AS eligible, count(*) FILTER (old) AS dup FROM sn GROUP BY 1, 2),
hd AS (SELECT req_id, idx, length(text) AS chars, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS head FROM m WHERE is_obs),
hs AS (SELECT *, min(idx) OVER (PARTITION BY req_id, head) < idx AND length(head) > 20 AS same_head FROM hd),
r AS (SELECT req_id, idx, chars, same_head, coalesce(eligible, 0) AS eligible, coalesce(dup, 0) AS dup, coalesce(dup, 0) / greatest(coalesce(eligible, 0), 1) AS frac FROM hs LEFT JOIN ct USING (req_id, idx))"""


def _redundant(spark, d):
    return ev.redundancy(tables.document_messages(spark, d).where("is_obs"), "req_id", "idx", "text")


@query("observation_strata", _REDUNDANT + """,
g AS (SELECT req_id, idx, concat_ws(',', CASE WHEN frac > 0.4 AND dup >= 5 THEN 'A_exact_redundancy' END, CASE WHEN same_head THEN 'B_repeated_file_read' END,
 CASE WHEN chars > 4000 THEN 'C_large_output' END, CASE WHEN frac < 0.1 AND chars > 1000 THEN 'E_active_dependency' END,
 CASE WHEN frac > 0.2 AND frac < 0.8 AND dup >= 3 THEN 'F_hard_negative' END, CASE WHEN same_head AND frac > 0.5 THEN 'D_superseded_state' END) AS s FROM r)
SELECT req_id, idx, CASE WHEN s = '' THEN 'H_control' ELSE s END AS strata FROM g""")
def _(spark, d):
    """All strata of each observation."""
    return ev.observation_strata(_redundant(spark, d)).select("req_id", "idx", F.array_join("strata", ",").alias("strata"))


@query("strata_counts", _REDUNDANT + """
SELECT CASE WHEN frac > 0.4 AND dup >= 5 THEN 1 ELSE 0 END::BIGINT AS a, count(*)::BIGINT AS observations, sum(dup)::BIGINT AS duplicates, sum(eligible)::BIGINT AS eligible FROM r GROUP BY 1""")
def _(spark, d):
    """Counts of observations, repeated and eligible lines by exact redundancy."""
    r = ev.observation_strata(_redundant(spark, d))
    return r.groupBy(F.array_contains("strata", "A_exact_redundancy").cast("int").alias("a")).agg(F.count(F.lit(1)).alias("observations"), F.sum("dup").alias("duplicates"), F.sum("eligible").alias("eligible"))


@query("eligibility_replay", _REDUNDANT + """,
v AS (SELECT *, chars >= 2000 AND dup >= 5 AS ok FROM r)
SELECT req_id, count(*)::BIGINT AS n_steps, count(*) FILTER (ok)::BIGINT AS n_available, round(min_by(frac, idx) FILTER (ok), 4) AS first_dup_frac,
 round(max(frac), 4) AS max_dup_frac, max(chars)::BIGINT AS max_chars FROM v GROUP BY 1""")
def _(spark, d):
    """Each request's steps under the availability gate."""
    return ev.replay(_redundant(spark, d), "req_id", "idx")


@query("decision_points", DM + """
SELECT req_id, idx AS point, length(text)::BIGINT AS chars FROM m WHERE is_obs AND length(text) >= 2000
QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY length(text) DESC, idx DESC) = 1""")
def _(spark, d):
    """The largest observation of each request, ties to the last."""
    return ev.decision_point(tables.document_messages(spark, d).where("is_obs"), "req_id", "idx", "text")


@query("blind_decision_view", DM + """,
p AS (SELECT req_id, idx AS point, length(text)::BIGINT AS chars FROM m WHERE is_obs AND length(text) >= 2000
 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY length(text) DESC, idx DESC) = 1)
SELECT req_id, point, chars, count(*)::BIGINT AS n_before, md5(substr(min_by(text, idx), 1, 1500)) AS excerpt FROM m JOIN p USING (req_id) WHERE idx < point GROUP BY 1, 2, 3""")
def _(spark, d):
    """What is seen at a decision point, and nothing after it."""
    m = tables.document_messages(spark, d)
    view = ev.blind_view(m, ev.decision_point(m.where("is_obs"), "req_id", "idx", "text"), "req_id", "idx", "text")
    return view.select("req_id", "point", "chars", "n_before", F.md5("task_excerpt").alias("excerpt"))


@query("identical_reruns", E + """
SELECT trace_id, CASE WHEN count(*) FILTER (etype = 'TEST') > 0 THEN count(args_hash) FILTER (etype = 'TEST') - count(DISTINCT args_hash) FILTER (etype = 'TEST') END::BIGINT AS identical_reruns
FROM e GROUP BY 1""")
def _(spark, d):
    """Tests run again word for word."""
    return ev.identical_reruns(tables.events(spark, d), "trace_id", "etype", "args_hash")


@query("sequence_memo", E + """,
x AS (SELECT *, min(event_index) FILTER (etype = 'READ' AND value < 50) OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS later,
 list(etype) OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM e),
y AS (SELECT *, list_position(k, 'EDIT') AS pos FROM x)
SELECT trace_id, count(*) FILTER (value >= 50 AND later IS NOT NULL)::BIGINT AS narrowed, count(*) FILTER (etype = 'TOOL_ERROR')::BIGINT AS edit_failures,
 CASE WHEN count(*) FILTER (etype = 'TOOL_ERROR') >= 2 THEN min(event_index) FILTER (etype = 'TOOL_ERROR') END AS failures_from,
 CASE WHEN count(*) FILTER (etype = 'TOOL_ERROR') >= 2 THEN max(event_index) FILTER (etype = 'TOOL_ERROR') END AS failures_to,
 count(*) FILTER (etype = 'SEARCH' AND value < 10)::BIGINT AS empty_searches,
 CASE WHEN count(*) FILTER (etype = 'SEARCH' AND value < 10) >= 2 THEN min(event_index) FILTER (etype = 'SEARCH' AND value < 10) END AS empties_from,
 CASE WHEN count(*) FILTER (etype = 'SEARCH' AND value < 10) >= 2 THEN max(event_index) FILTER (etype = 'SEARCH' AND value < 10) END AS empties_to,
 min(event_index) FILTER (pos > 0 AND list_contains(k, 'TEST') AND pos < len(k) AND len(k) >= 3) AS edit_test_at,
 min(event_index) FILTER (etype = 'OTHER' AND value < 5) AS environment_at FROM y GROUP BY 1""")
def _(spark, d):
    """The five patterns of a trace's observations."""
    kind, value = F.col("etype"), F.col("value")
    return ev.memo(tables.events(spark, d), "trace_id", "event_index", "etype", value >= 50, (kind == "READ") & (value < 50), kind == "TOOL_ERROR", (kind == "SEARCH") & (value < 10), (kind == "OTHER") & (value < 5))


@query("label_ids", "SELECT doc_id AS unit, coalesce(lang, 'none') AS label_id FROM documents")
def _(spark, d):
    """Labels told from a plain text, a JSON text, an object and a map of one key."""
    u = tables.read(spark, d, "documents").select(F.col("doc_id").alias("unit"), F.coalesce("lang", F.lit("none")).alias("label"))
    k = F.pmod("unit", F.lit(5))
    shape = F.when(k == 0, F.col("label")).when(k == 1, F.concat(F.lit('"'), "label", F.lit('"'))).when(k == 2, F.concat(F.lit('{"label": "'), "label", F.lit('", "severity": "high"}')))
    shape = shape.when(k == 3, F.concat(F.lit('{"l2": "'), "label", F.lit('"}'))).otherwise(F.concat(F.lit('{"'), "label", F.lit('": "low"}')))
    return u.select("unit", ev.label_id(shape).alias("label_id"))


@query("recovered_traces", "SELECT 's' || doc_id AS sample_id, 't' || lpad(doc_id::VARCHAR, 10, '0') AS trace_id FROM documents")
def _(spark, d):
    """Trace ids from a field, a name, a unique prefix or the place in a shard."""
    u = tables.read(spark, d, "documents").select("doc_id", F.concat(F.lit("t"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"), F.pmod("doc_id", F.lit(7)).alias("shard"), F.floor(F.col("doc_id") / 7).alias("place"), F.pmod("doc_id", F.lit(4)).alias("k"))
    name = F.when(F.col("k") == 1, F.concat(F.lit("s"), "doc_id", F.lit("-trace-"), "id")).otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    samples = u.select(name.alias("sample_id"), F.when(F.col("k") == 0, F.col("id")).alias("trace_id"), F.when(F.col("k") == 2, F.col("id")).alias("prefix"), F.when(F.col("k") == 3, F.col("shard")).alias("shard"), F.when(F.col("k") == 3, F.col("place")).alias("place"))
    got = ev.recover_trace(samples, u.select(F.col("id").alias("trace_id"), "shard", "place"))
    return got.select(F.regexp_replace("sample_id", "-trace-.*", "").alias("sample_id"), "trace_id")


@query("request_events", _REDUNDANT + """,
n AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY idx DESC) AS rn FROM r),
z AS (SELECT req_id, idx, chars, eligible, dup, frac, req_id % 5 <> 0 AS known, chars >= 2000 AND dup >= 5 AS ok,
 CASE WHEN frac > 0.4 THEN 'HIGH_REDUNDANCY' WHEN frac > 0 AND dup >= 5 THEN 'MIXED_REDUNDANCY' ELSE 'NONE' END AS s FROM n WHERE rn = 1)
SELECT req_id, idx, known AS task_known, CASE WHEN known THEN chars ELSE 0 END::BIGINT AS segment_chars, CASE WHEN known THEN dup ELSE 0 END::BIGINT AS duplicate_lines,
 round(CASE WHEN known THEN frac ELSE 0 END, 4) AS dup_frac, known AND ok AS available, CASE WHEN known THEN s ELSE '' END AS stratum,
 known AND ok AND s <> 'NONE' AS randomise, CASE WHEN NOT known THEN 'unknown_task_fingerprint' END AS provider_error, NOT known AS infrastructure_failure FROM z""")
def _(spark, d):
    """ST1, ST4, ST9, ST11: event records of requests: gate, stratum, and unknown tasks closed out."""
    m = tables.document_messages(spark, d)
    known = m.select("req_id").distinct().where("req_id % 5 <> 0")
    return requests.event_records(m, known, "req_id", "idx", "text", "is_obs", "randomize").drop("assignment", "propensity", "eligible_lines", "call_class")


@query("attached_outcomes", """
SELECT l_orderkey AS event_id, l_linenumber::BIGINT AS call_index, CASE WHEN l_discount > 0 THEN round(l_quantity + 0.1 * l_extendedprice + 1.25 * l_tax * 1000 + 5 * l_discount * 100, 4) END AS effective_cost,
 l_discount = 0 AS infrastructure_failure, CASE WHEN l_discount = 0 THEN 'bad_upstream' END AS provider_error FROM lineitem""")
def _(spark, d):
    """ST10: costs attached to events; an answer without usage is a failure, not a cost of 0."""
    li = tables.read(spark, d, "lineitem")
    events = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("call_index"), "l_partkey", "l_suppkey", "l_extendedprice")
    return requests.attach_outcome(
        events.join(li.where("l_discount > 0").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("call_index"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("input_tokens"), F.col("l_extendedprice").alias("cache_read_tokens"), (F.col("l_tax") * 1000).alias("cache_creation_tokens"), (F.col("l_discount") * 100).alias("output_tokens")), ["event_id", "call_index", "l_partkey", "l_suppkey", "l_extendedprice"], "left")
    ).select("event_id", "call_index", "effective_cost", "infrastructure_failure", "provider_error")


_U = "('0x' || substr(sha256(o_orderkey::VARCHAR || '|7'), 1, 8))::BIGINT / 4294967296.0"


@query("weighted_actions", f"SELECT o_orderkey AS event_id, CASE WHEN {_U} < 0.5 THEN 'NO_OP' WHEN {_U} < 0.75 THEN 'LINEDEDUP' ELSE 'GENTLE_CAP' END AS action, CASE WHEN {_U} < 0.5 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS propensity FROM orders")
def _(spark, d):
    """ST13, ST12, Z21: an action by weight from the event's hash, the same in every process."""
    return requests.weighted_action(tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), "event_id", {"NO_OP": 0.5, "LINEDEDUP": 0.25, "GENTLE_CAP": 0.25}, 7)


@query("training_examples", """
SELECT doc_id AS example_id, '{"input":{"lang":"' || lang || '","tier":"' || CASE WHEN doc_id % 3 = 0 THEN 'UNK' ELSE 'STRONG' END || '","n":' || n_chars || '},"target":{"quality":' || quality || '}}' AS example
FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND n_chars IS NOT NULL""")
def _(spark, d):
    """K5: training examples of input and target; a missing tier is UNK."""
    u = tables.read(spark, d, "documents").join(tables.read(spark, d, "labels"), "doc_id").where("lang is not null and n_chars is not null")
    u = u.withColumn("tier", F.when(F.col("doc_id") % 3 != 0, "STRONG")).withColumnsRenamed({"n_chars": "n"})
    return sinks.training_examples(u, "doc_id", ("lang", "tier", "n"), ("quality",)).select(F.col("doc_id").alias("example_id"), "example")


@query("public_manifest", "SELECT page_id AS unit, substr(sha256(url), 1, 16) AS locator FROM pages")
def _(spark, d):
    """K4: the public side of a manifest names no path; the private one finds it by the same key."""
    public, private = sinks.split_projection(tables.read(spark, d, "pages").select(F.col("page_id").alias("unit"), F.col("url").alias("path")), "path")
    return public.join(private.select("unit", "locator"), ["unit", "locator"])


@query("recurrence_by_kind", E + """,
a AS (SELECT *, list(target) FILTER (etype = 'SEARCH') OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
 list(target) FILTER (etype <> 'SEARCH') OVER (PARTITION BY trace_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM e)
SELECT trace_id, event_index, coalesce(list_contains(p[-2:], target), false) AS in_plans, coalesce(list_contains(o[-3:], target), false) AS in_outputs FROM a""")
def _(spark, d):
    """Does an event's target stand in the last two plans, or the last three tool outputs?"""
    return sequence.recurrence_by_kind(tables.events(spark, d), "trace_id", "event_index", "target", F.col("etype") == "SEARCH")
