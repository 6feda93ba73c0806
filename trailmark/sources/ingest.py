"""Raw trajectory files, ledgers and grade reports to canonical tables.

Four layouts of JSON are told apart by their keys: classic (``trajectory`` steps),
fenced messages, function-call messages, and unknown.  A bare list is lifted to an
object with ``messages``.  Message content may be a string or an array of blocks; it
is read as text and normalised once here.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

RAW = """struct<trajectory_format: string, trajectory: array<struct<action: string, observation: string, thought: string, response: string, state: string>>,
 messages: array<struct<role: string, content: string>>, info: struct<exit_status: string, submission: string,
 model_stats: struct<tokens_sent: bigint, tokens_received: bigint, api_calls: bigint, instance_cost: double>>>"""
LEDGER = """task_id string, method string, call_index long, request_id string, changed boolean, characters_removed long, input_tokens long,
 cache_read_tokens long, cache_creation_tokens long, output_tokens long, latency_seconds double, timestamp double, stop string"""
THOUGHT_CHARS, OBSERVATION_CHARS, ARGUMENT_CHARS = 500, 20_000, 200


def read_raw(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, task_id (the file's name up to its first dot), and the document as text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1)
    return lift(files.select(F.col("_metadata.file_path").alias("path"), name.alias("task_id"), F.col("value").alias("raw")))


def lift(files: DataFrame) -> DataFrame:
    """A bare list becomes an object with ``messages``."""
    bare = F.col("raw").rlike(r"^\s*\[")
    return files.withColumn("raw", F.when(bare, F.concat(F.lit('{"messages":'), F.col("raw"), F.lit(',"_bare_list":true}'))).otherwise(F.col("raw")))


def text_of(content: Column) -> Column:
    """Text of a message's content: a string, or blocks whose texts are joined by line
    feeds; a tool result's content is again a string or blocks."""
    kind = "array<struct<type: string, text: string, content: string>>"
    inner = lambda c: F.coalesce(F.array_join(F.transform(F.from_json(F.when(c.rlike(r"^\s*\[\s*\{"), c), kind), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), c, F.lit(""))
    blocks = F.from_json(F.when(content.rlike(r"^\s*\[\s*\{"), content), kind)
    return F.coalesce(F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], inner(b["content"]))), "\n"), content, F.lit(""))


def layout(d: Column) -> Column:
    """classic_traj, mini_swe_agent, openhands or unknown, of a parsed document."""
    said = lambda keep, n: F.array_join(F.transform(F.slice(F.filter(d["messages"], keep), 1, n), lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    calls = F.substring(said(lambda m: m["role"] == "assistant", 1_000_000), 1, 5000)
    first = F.array_join(F.transform(F.slice(d["messages"], 1, 4), lambda m: F.substring(F.coalesce(m["content"], F.lit("")), 1, 300)), " ")
    functions = F.contains(calls, F.lit("<function=")) | F.contains(first, F.lit("OpenHands")) | F.contains(first, F.lit("EXECUTION RESULT"))
    return (
        F.when(F.startswith(d["trajectory_format"], F.lit("mini")), "mini_swe_agent")
        .when(d["messages"].isNotNull() & d["trajectory"].isNull(), F.when(functions, "openhands").otherwise("mini_swe_agent"))
        .when(d["trajectory"].isNotNull(), "classic_traj").otherwise("unknown")
    )


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def fenced(content: Column) -> tuple[Column, Column]:
    """(thought, action) of a message with THOUGHT and a fenced command."""
    thought = _some(C.strip(F.regexp_extract(content, r"(?is)THOUGHT:\s*(.+?)(?=```|ACTION:|\z)", 1)))
    fence = _some(C.strip(F.regexp_extract(content, r"(?s)```(?:bash|sh)?\s*(.+?)```", 1)))
    action = F.coalesce(fence, _some(C.strip(F.regexp_extract(content, r"(?is)ACTION:\s*(.+)\z", 1))))
    return F.when(thought.isNull() & action.isNull(), _some(F.substring(C.strip(content), 1, THOUGHT_CHARS))).otherwise(thought), action


def function_call(content: Column) -> tuple[Column, Column, Column]:
    """(thought, command, function) of a message with a function call."""
    name = _some(F.regexp_extract(content, r"<function=(\w+)>", 1))
    command = _some(C.strip(F.regexp_extract(content, r"(?s)<parameter=(?:command|cmd)>(.*?)</parameter>", 1)))
    other = _some(F.substring(C.strip(F.regexp_extract(content, r"(?s)<parameter=(?:path|file_text|new_str|old_str|view_range)>(.*?)</parameter>", 1)), 1, ARGUMENT_CHARS))
    before = C.strip(F.when(name.isNotNull(), F.regexp_extract(content, r"(?s)^(.*?)<function=", 1)).otherwise(content))
    return _some(F.substring(before, 1, THOUGHT_CHARS)), F.coalesce(command, other), name


def steps(raw: DataFrame) -> DataFrame:
    """task_id, layout, event_index, thought, action, tool, observation, diff of each step."""
    d = raw.select("*", F.from_json("raw", RAW).alias("d"))
    d = d.withColumn("layout", layout(F.col("d")))
    keep = [c for c in raw.columns if c != "raw"]
    t = F.col("s")
    classic = d.where("layout = 'classic_traj'").select(*keep, "layout", F.posexplode("d.trajectory").alias("event_index", "s"))
    classic = classic.select(
        *keep, "layout", "event_index", F.coalesce(_some(t["thought"]), F.when(F.coalesce(t["action"], F.lit("")) == "", t["response"])).alias("thought"), t["action"].alias("action"),
        F.lit(None).cast("string").alias("tool"), t["observation"].alias("observation"), _some(F.get_json_object(t["state"], "$.diff")).alias("diff"),
    )
    m = d.where("layout in ('mini_swe_agent', 'openhands')").select(*keep, "layout", F.posexplode("d.messages").alias("at", "m"))
    m = m.select(*keep, "layout", "at", F.col("m.role").alias("role"), text_of(F.col("m.content")).alias("content"))
    w = Window.partitionBy(*keep).orderBy("at")
    m = m.withColumn("next_role", F.lead("role").over(w)).withColumn("next", F.lead("content").over(w)).where("role = 'assistant'")
    m = m.withColumn("event_index", F.row_number().over(w) - 1)
    c = F.col("content")
    (f_thought, f_action), (o_thought, o_action, o_tool) = fenced(c), function_call(c)
    is_call = F.col("layout") == "openhands"
    observed = F.when(F.col("next_role").isin("user", "tool"), F.col("next"))
    m = m.select(
        *keep, "layout", "event_index", F.when(is_call, o_thought).otherwise(f_thought).alias("thought"), F.when(is_call, o_action).otherwise(f_action).alias("action"),
        F.when(is_call, o_tool).alias("tool"), observed.alias("observation"), F.lit(None).cast("string").alias("diff"),
    )
    return classic.unionByName(m)


def events(raw: DataFrame, solver: str) -> DataFrame:
    """The canonical event of each step: types, hashes, paths, errors; counts of tokens
    that a file doesn't have are null, never 0."""
    s = steps(raw)
    action, obs, thought = F.col("action"), F.col("observation"), F.col("thought")
    kind = C.event_type(action, thought, obs)
    some = F.coalesce(action, F.lit("")) != ""
    return s.select(
        F.concat_ws("@", "task_id", F.lit(solver)).alias("trace_id"), "task_id",
        F.when(F.contains("task_id", F.lit("__")), F.split("task_id", "__")[0]).alias("repo"), F.lit(solver).alias("solver_alias"), F.col("layout").alias("source_harness"),
        "event_index", F.when(some, F.substring(C.normalize_space(action), 1, 60)).when(thought.isNotNull(), "thought").alias("raw_action_type"),
        kind.alias("normalized_action_type"), F.col("tool").alias("tool_name"), F.when(some, C.content_hash(C.normalize_space(action))).alias("tool_args_hash"),
        C.content_hash(F.nullif(obs, F.lit(""))).alias("tool_output_hash"), C.paths(F.concat_ws(" ", F.coalesce(action, F.lit("")), F.coalesce(obs, F.lit("")))).alias("file_paths"),
        F.when(kind == "TEST", action).alias("test_command"), F.when(kind == "TEST", C.test_result(obs)).alias("test_result"), C.error_marker(obs).alias("error_type"),
        C.content_hash(F.col("diff")).alias("patch_delta_hash"), *(F.lit(None).cast("long").alias(t) for t in ("input_tokens", "output_tokens", "context_tokens")),
        (action.isNotNull() | obs.isNotNull() | thought.isNotNull()).alias("content_available"),
    )


def outcomes(raw: DataFrame) -> DataFrame:
    """Exit status, whether there is a submission (null if the key is missing), and usage."""
    d = raw.select("task_id", F.from_json("raw", RAW).alias("d"))
    return d.select("task_id", layout(F.col("d")).alias("layout"), F.col("d.info.exit_status").alias("exit_status"), (F.col("d.info.submission") != "").alias("submission_present"), F.col("d.info.model_stats.*"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of calls; lines that don't parse, blank ones too, are left out."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def grades(reports: DataFrame) -> DataFrame:
    """task_id and resolved of grade reports (tag, raw): ``resolved_ids`` or
    ``resolved_instances`` against ``completed_ids``."""
    d = reports.select("tag", F.from_json("raw", "struct<completed_ids: array<string>, resolved_ids: array<string>, resolved_instances: array<string>>").alias("d"))
    good = F.coalesce("d.resolved_ids", "d.resolved_instances", F.array().cast("array<string>"))
    every = F.array_union(F.coalesce("d.completed_ids", F.array().cast("array<string>")), good)
    return d.select("tag", good.alias("good"), F.explode(every).alias("task_id")).select("tag", "task_id", F.array_contains("good", F.col("task_id")).alias("resolved"))


def resolved_flag(raw: Column, instance: Column) -> Column:
    """``resolved`` of a report: at the top, under the instance, or in the first object."""
    nested = F.from_json(raw, "map<string, string>")
    of = lambda text: F.get_json_object(text, "$.resolved").cast("boolean")
    others = F.filter(F.transform(F.map_values(nested), of), lambda r: r.isNotNull())
    return F.coalesce(of(raw), of(nested[instance]), F.get(others, F.lit(0)))


def fingerprints(requests: DataFrame) -> DataFrame:
    """Task of each hash of a first user message's 2000 characters; the last load wins."""
    h = C.content_hash(F.substring("first_user_text", 1, 2000))
    return requests.select(h.alias("fingerprint"), "task_id", "load_order").groupBy("fingerprint").agg(F.max_by("task_id", "load_order").alias("task_id"))


def transcript_rows(transcripts: DataFrame) -> DataFrame:
    """Steps of rendered transcripts (id, text): a header ``[n] TYPE | action`` and the
    ``thought:`` and ``obs:`` lines that follow it."""
    lines = transcripts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    head = r"^\[(\d+)\]\s+(\w+)\s+\|\s+(.*)$"
    island = F.sum(F.col("line").rlike(head).cast("int")).over(Window.partitionBy("id").orderBy("no"))
    marked = lines.withColumn("step", island).where("step > 0")
    pick = lambda label: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").rlike(rf"^\s*{label}:"), F.struct("no", F.regexp_extract("line", rf"^\s*{label}:\s*(.*)$", 1).alias("t"))))), lambda x: x["t"]), "\n")
    first = F.min_by("line", "no")
    return marked.groupBy("id", "step").agg(F.regexp_extract(first, head, 1).cast("int").alias("event_index"), F.regexp_extract(first, head, 2).alias("etype"), F.regexp_extract(first, head, 3).alias("action"), pick("thought").alias("thought"), pick("obs").alias("observation")).drop("step")


def find_json(text: str | None) -> str | None:
    """The JSON of a free text: a fenced block, else the largest balanced object or
    array, else the whole text, else nothing."""
    if not text:
        return None
    options = re.findall(r"```(?:json)?\s*(.+?)```", text, re.S)
    spans = []
    for opening, closing in ("{}", "[]"):
        depth, start = 0, 0
        for i, c in enumerate(text):
            if c == opening:
                start = i if not depth else start
                depth += 1
            elif c == closing and depth:
                depth -= 1
                if not depth:
                    spans.append(text[start : i + 1])
    for option in [*options, *sorted(spans, key=len, reverse=True), text]:
        try:
            return json.dumps(json.loads(option), sort_keys=True)
        except ValueError:
            continue
    return None


def extract_json(text: Column) -> Column:
    """``find_json`` of a column; balanced brackets are no regular language, so in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(find_json)

    return run(text)


def render(events_: DataFrame, cutoff: int | None = None) -> DataFrame:
    """One text a trace, a line for each of its first ``cutoff`` events."""
    line = F.concat(F.lit("["), F.col("event_index").cast("string"), F.lit("] "), F.col("normalized_action_type"), F.lit(" | "), F.coalesce("raw_action_type", F.lit("")))
    kept = events_.where(F.col("event_index") < cutoff) if cutoff is not None else events_
    return kept.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
