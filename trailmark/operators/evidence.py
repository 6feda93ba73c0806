"""What segments, observations and traces show: scanners, strata, decision points, memos.

Segments are rows (key, order, text); windows by key share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Patterns of what a segment names.
PATHS = r"\b[\w./-]+\.(?:py|txt|cfg|ini|toml|rst|md|json|yaml|yml|c|h|cpp|js|ts)\b"
FUNCTIONS = r"\bdef\s+([A-Za-z_]\w*)"
CLASSES = r"\bclass\s+([A-Za-z_]\w*)"
ERRORS = r"\b(?:Error|Exception|Traceback|assert|FAILED|FAIL|failed)\b"
TRACEBACK_LINES = r'(?m)^\s*File "'
TESTS = r"\b(?:test_\w+|\w+_test|::test)\b"
SHELL = r"\b(?:python|pytest|pip|cd|ls|cat|grep|git|make)\b"
TRANSIENT = r"\b(?:0x[0-9a-f]{6,}|/tmp/|PID|timestamp)\b"
#: What an editor says when it has not, or has, changed a file.
EDIT_FAILED = r"(?i)(No replacement was performed|did not appear verbatim|multiple occurrences|_split_string|future feature annotations|No edit was made|Parameter .* is required)"
#: Marks of a patch in a message.
PATCH_MARKS = ("diff --git", "+++ b/")
#: A decision point: characters of its segment, lines it repeats, and the share that makes it highly redundant.
MIN_SEGMENT, MIN_DUPLICATES, HIGH_REDUNDANCY = 2000, 5, 0.40
#: Characters of a line that counts.
MIN_LINE = 12


def _total(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _distinct(text: Column, pattern: str, group: int = 0) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def scan(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Counts and flags of a segment's content: names are counted once, marks every time.

    Null text has none of anything."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = df.select(*keep, _distinct(t, PATHS).alias("n_paths"), _distinct(t, FUNCTIONS, 1).alias("n_funcs"), _distinct(t, CLASSES, 1).alias("n_classes"), _total(t, ERRORS).alias("n_errors"), _total(t, TRACEBACK_LINES).alias("n_traceback_lines"), _distinct(t, TESTS).alias("n_tests"), _total(t, SHELL).alias("n_shell"), t.rlike(TRANSIENT).alias("transient_state"), F.length(t).alias("n_chars"))
    read = (F.col("n_paths") > 0) & (F.col("n_errors") == 0)
    return counts.withColumns({"looks_like_file_read": read, "looks_like_test_output": (F.col("n_tests") > 0) | (F.col("n_traceback_lines") > 0)})


def edit_outcome(text: Column) -> Column:
    """'failed' dominates; any other words of the editor mean 'applied'; none, null."""
    return F.when(text.rlike(EDIT_FAILED), "failed").when(F.length(text) > 0, "applied")


def call_kind(requests: DataFrame, key: str, role: str) -> DataFrame:
    """'internal_setup' for requests of at most two messages or without an assistant's."""
    n, said = F.count(F.lit(1)), F.count_if(F.col(role) == "assistant")
    return requests.groupBy(key).agg(n.alias("n_messages"), F.when((n <= 2) | (said == 0), "internal_setup").otherwise("main_agent_call").alias("call_class"))


def phase(has_patch: Column, has_tests: Column) -> Column:
    """The phase of work: a patch first, then tests."""
    return F.when(has_patch, "implementation_or_verification").when(has_tests, "diagnosis_with_tests").otherwise("early_diagnosis")


def behaviour_mix(searches: Column, edits: Column, tests: Column) -> Column:
    """The most frequent of search, edit and test; of equals the first of these."""
    most = F.greatest(searches, edits, tests)
    return F.when(most == 0, "other").when(searches == most, "search_heavy").when(edits == most, "edit_heavy").otherwise("test_heavy")


def behaviour_axes(searches: Column, edits: Column, tests: Column, error_rate: Column, actions: Column) -> Column:
    """All axes a trace is on; 'generic' if none."""
    axes = F.array_compact(F.array(
        F.when(searches >= 5, "search_heavy"), F.when(edits >= 5, "edit_heavy"), F.when(tests >= 2, "test_heavy"),
        F.when(error_rate >= 0.15, "high_error").when(error_rate == 0, "low_error"), F.when(actions <= 8, "short_traj").when(actions >= 40, "long_traj"),
    ))
    return F.when(F.size(axes) > 0, axes).otherwise(F.array(F.lit("generic")))


def outcome_label(resolved: Column) -> Column:
    return F.when(resolved.isNull(), "UNKNOWN").when(resolved, "SOLVED").otherwise("UNSOLVED")


def redundancy(observations: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Of each observation: characters, eligible lines, those that an earlier observation
    of the key holds, and whether an earlier one has the same first line.

    One shuffle by (key, line), one by (key, order)."""
    line = F.explode(F.split(text, "\n", -1))
    lines = observations.select(key, order, line.alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where(F.length("line") >= MIN_LINE)
    seen = lines.withColumn("old", F.min(order).over(Window.partitionBy(key, "line")) < F.col(order))
    counted = seen.groupBy(key, order).agg(F.count(F.lit(1)).alias("eligible"), F.count_if("old").alias("dup"))
    head = F.regexp_replace(F.substring_index(F.col(text), "\n", 1), r"^\s+|\s+$", "")
    rows = observations.select(key, order, F.length(text).alias("chars"), head.alias("head"))
    again = (F.min(order).over(Window.partitionBy(key, "head")) < F.col(order)) & (F.length("head") > 20)
    both = rows.withColumn("same_head", again).join(counted, [key, order], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(key, order, "chars", "same_head", zero("eligible").alias("eligible"), zero("dup").alias("dup"), (zero("dup") / F.greatest(zero("eligible"), F.lit(1))).alias("dup_frac"))


def observation_strata(redundant: DataFrame) -> DataFrame:
    """``redundant`` with all strata of each observation, in order; 'H_control' if none."""
    frac, dup, chars = F.col("dup_frac"), F.col("dup"), F.col("chars")
    tags = F.array_compact(F.array(
        F.when((frac > 0.4) & (dup >= 5), "A_exact_redundancy"), F.when(F.col("same_head"), "B_repeated_file_read"), F.when(chars > 4000, "C_large_output"),
        F.when((frac < 0.1) & (chars > 1000), "E_active_dependency"), F.when((frac > 0.2) & (frac < 0.8) & (dup >= 3), "F_hard_negative"),
        F.when(F.col("same_head") & (frac > 0.5), "D_superseded_state"),
    ))
    return redundant.withColumn("strata", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("H_control"))))


def moderator(frac: Column, dup: Column) -> Column:
    return F.when(frac > HIGH_REDUNDANCY, "HIGH_REDUNDANCY").when((frac > 0) & (dup >= MIN_DUPLICATES), "MIXED_REDUNDANCY").otherwise("NONE")


def available(redundant: DataFrame) -> DataFrame:
    """The availability gate: a long enough segment that repeats enough lines; and its stratum."""
    gate = (F.col("chars") >= MIN_SEGMENT) & (F.col("dup") >= MIN_DUPLICATES)
    return redundant.withColumns({"available": gate, "stratum": moderator(F.col("dup_frac"), F.col("dup"))})


def replay(redundant: DataFrame, key: str, order: str) -> DataFrame:
    """Every key's steps under the gate: how many were available, the first one's share of
    repeated lines (null if none), and the greatest share and size."""
    a = available(redundant)
    first = F.min_by("dup_frac", F.when(F.col("available"), F.col(order)))
    return a.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps"), F.count_if("available").alias("n_available"), first.alias("first_dup_frac"), F.max("dup_frac").alias("max_dup_frac"), F.max("chars").alias("max_chars"))


def decision_point(observations: DataFrame, key: str, order: str, text: str, least: int = MIN_SEGMENT) -> DataFrame:
    """The largest observation of ``least`` characters or more; of equals the last."""
    size = F.length(text)
    return observations.where(size >= least).groupBy(key).agg(F.max(F.struct(size.alias("chars"), F.col(order).alias("point"))).alias("p")).select(key, F.col("p.point").alias("point"), F.col("p.chars").alias("chars"))


def blind_view(messages: DataFrame, points: DataFrame, key: str, order: str, text: str, excerpt: int = 1500) -> DataFrame:
    """What may be seen at a decision point: the number of messages before it and the
    beginning of the first one; nothing of what came after."""
    before = messages.join(points, key).where(F.col(order) < F.col("point"))
    return before.groupBy(key, "point", "chars").agg(F.count(F.lit(1)).alias("n_before"), F.substring(F.min_by(text, order), 1, excerpt).alias("task_excerpt"))


def identical_reruns(events: DataFrame, key: str, kind: str, args: str, test: str = "TEST") -> DataFrame:
    """Tests that repeat an earlier test of the trace word for word; null without tests."""
    is_test = F.col(kind) == test
    tests = F.count_if(is_test)
    return events.groupBy(key).agg(F.when(tests > 0, F.count(F.when(is_test, F.col(args))) - F.count_distinct(F.when(is_test, F.col(args)))).alias("identical_reruns"))


def memo(events: DataFrame, key: str, order: str, kind: str, oversized: Column, narrow: Column, edit_failed: Column, empty: Column, environment: Column, ahead: int = 4) -> DataFrame:
    """Five patterns of each trace's observations, as (start, end) where they hold.

    Oversized output with a narrower read among the next ``ahead``; two or more failed
    edits; two or more empty searches; an edit with a test in a window of ``ahead`` rows
    that begins at or before it; and the first sign of the environment failing.
    """
    w = Window.partitionBy(key).orderBy(order)
    later = F.min(F.when(F.col("_n"), F.col(order))).over(w.rowsBetween(1, ahead))
    kinds = F.collect_list(kind).over(w.rowsBetween(0, ahead - 1))
    e = events.withColumns({"_n": narrow, "_o": oversized, "_f": edit_failed, "_e": empty, "_v": environment}).withColumns({"_later": later, "_kinds": kinds})
    position = F.array_position("_kinds", F.lit("EDIT"))
    healthy = (position > 0) & F.array_contains("_kinds", "TEST") & (position < F.size("_kinds")) & (F.size("_kinds") >= 3)
    pair = lambda p: (F.count_if(p), F.min(F.when(p, F.col(order))), F.max(F.when(p, F.col(order))))
    narrowed = F.col("_o") & F.col("_later").isNotNull()
    fails, empties = pair(F.col("_f")), pair(F.col("_e"))
    return e.groupBy(key).agg(
        F.count_if(narrowed).alias("narrowed"), fails[0].alias("edit_failures"), F.when(fails[0] >= 2, fails[1]).alias("failures_from"), F.when(fails[0] >= 2, fails[2]).alias("failures_to"),
        empties[0].alias("empty_searches"), F.when(empties[0] >= 2, empties[1]).alias("empties_from"), F.when(empties[0] >= 2, empties[2]).alias("empties_to"),
        F.min(F.when(healthy, F.col(order))).alias("edit_test_at"), F.min(F.when(F.col("_v"), F.col(order))).alias("environment_at"),
    )


def label_id(value: Column) -> Column:
    """The label of a JSON text: a string itself, an object's 'label', 'l2' or 'id', or a
    map's only key."""
    as_map = F.from_json(value, "map<string,string>")
    plain = F.when(~value.rlike(r"^\s*[{\[]"), F.regexp_replace(value, r'^\s*"|"\s*$', ""))
    only = F.when(F.size(F.map_keys(as_map)) == 1, F.element_at(F.map_keys(as_map), 1))
    return F.coalesce(plain, *(F.get_json_object(value, f"$.{k}") for k in ("label", "l2", "id")), only)


def recover_trace(samples: DataFrame, known: DataFrame) -> DataFrame:
    """sample_id, trace_id: the sample's own field, else the id in its name ('...trace-<id>'),
    else the only known trace that begins with its prefix, else the known trace at its place
    in the shard.

    ``samples``: sample_id, trace_id, prefix, shard, place; ``known``: trace_id, shard, place.
    """
    in_name = F.nullif(F.regexp_extract("sample_id", r"trace-(\w+)$", 1), F.lit(""))
    first = samples.withColumn("found", F.coalesce("trace_id", in_name))
    sizes = sorted(r["n"] for r in samples.where(F.col("prefix").isNotNull()).select(F.length("prefix").alias("n")).distinct().limit(64).collect())  # lengths of prefixes
    starts = known.select("trace_id", F.explode(F.array(*(F.substring("trace_id", 1, n) for n in sizes)) if sizes else F.array().cast("array<string>")).alias("prefix")).distinct()
    unique = starts.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("trace_id").alias("by_prefix")).where("n = 1").drop("n")
    placed = known.select(F.col("trace_id").alias("by_place"), "shard", "place")
    joined = first.join(unique, "prefix", "left").join(placed, ["shard", "place"], "left")
    return joined.select("sample_id", F.coalesce("found", "by_prefix", "by_place").alias("trace_id"))
