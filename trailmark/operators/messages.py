"""Transforms of message arrays in long form: (req_id, idx, role, text, is_obs).

Each transform maps a frame to the same frame with new text in observations; rows,
roles and order never change.  Content transforms are row-local expressions, others
look at recency or at earlier rows through windows by request.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strip

Transform = Callable[[DataFrame], DataFrame]

# --- fixed values -----------------------------------------------------------
ERROR_WORDS = ("error", "traceback", "failed", "exception", "fatal", "no such file", "permission denied")
BUILD_FAILURES = ("error", "traceback", "failed", "fatal", "exit code 1", "returncode>0")
SMART_MARKS = ("error", "traceback", "exception", "failed", "assert", "fatal", " E ", "FAILED", "Error")
GENTLE_MARKS = ("error", "traceback", "exception", "failed", "assert", "fatal", "Error", "FAILED")
SIGNAL = r"(?i)(error|traceback|exception|fail|assert|def |class |import |return |raise |^\+|^-|\.py[:\"]|line \d+|=== |\bE\b|warning|FAILED|PASSED|\bdef\b)"
READ_PATH = r"(?:cat|open|view|sed -n|head|tail|str_replace_editor[^\n]*?)\s+([/\w.\-]+\.\w{1,6})"
SEARCH_COMMAND = r"\b(grep|rg|find|search|ag|git grep)\b"
BUILD_COMMAND = r"(pip install|setup\.py|build_ext|make\b|conda |apt-get|cmake)"
# ----------------------------------------------------------------------------

def _text() -> Column:
    return F.col("text")


def _size() -> Column:
    return F.length("text")


_s = lambda c: c.cast("string")
_first = lambda n: F.substring(_text(), 1, n)
_last = lambda n: F.right(_text(), F.lit(n))


def _set(df: DataFrame, when: Column, new: Column) -> DataFrame:
    return df.withColumn("text", F.when(F.col("is_obs") & when, new).otherwise(_text()))


def _content(rule: Callable[[], tuple[Column, Column]]) -> Transform:
    return lambda df: _set(df, *rule())


def cap(chars: int, marker: str = "\n...[{} chars elided]...\n") -> Transform:
    head = int(chars * 0.6)
    before, after = marker.split("{}")
    return _content(lambda: (_size() > chars, F.concat(_first(head), F.lit(before), _s(_size() - chars), F.lit(after), _last(chars - head))))


def _recency(df: DataFrame) -> DataFrame:
    """Adds obs_rank: 1 for the newest observation of a request."""
    w = Window.partitionBy("req_id", "is_obs").orderBy(F.desc("idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy("req_id", "is_obs"))
    return df.withColumn("obs_rank", F.row_number().over(w)).withColumn("n_obs", n)


def _recent(rule: Callable[[Column, Column], tuple[Column, Column]]) -> Transform:
    return lambda df: _set(_recency(df), *rule(F.col("obs_rank"), F.col("n_obs"))).drop("obs_rank", "n_obs")


def window_clear(window: int, least: int = 200, text: str = "[earlier observation cleared; {} chars]") -> Transform:
    a, b = text.split("{}")
    return _recent(lambda rank, n: ((rank > window) & (_size() > least), F.concat(F.lit(a), _s(_size()), F.lit(b))))


def summarize_old(df: DataFrame) -> DataFrame:
    return _recent(lambda rank, n: ((rank > 6) & (_size() > 300), F.concat(_first(100), F.lit("..."), _last(50), F.lit(" ["), _s(_size()), F.lit(" chars total]"))))(df)


def hybrid(df: DataFrame) -> DataFrame:
    cleared = F.concat(F.lit("[old observation cleared; "), _s(_size()), F.lit(" chars]"))
    short = F.concat(_first(100), F.lit("..."), _last(50), F.lit(" ["), _s(_size()), F.lit("c]"))
    return _recent(lambda rank, n: ((n > 12) & (rank > 8) & (_size() > 200), F.when(rank > 12, cleared).otherwise(short)))(df)


def progressive(df: DataFrame) -> DataFrame:
    mild = F.concat(_first(1000), F.lit("\n...[compressed]...\n"), _last(500))
    hard = F.concat(_first(250), F.lit("...["), _s(_size()), F.lit("c]..."), _last(100))
    old = F.concat(_first(80), F.lit("... ["), _s(_size()), F.lit("c total, old]"))

    def rule(rank: Column, n: Column) -> tuple[Column, Column]:
        new = F.when(rank > 12, old).when(rank > 8, F.when(_size() > 500, hard).otherwise(_text())).otherwise(F.when(_size() > 2000, mild).otherwise(_text()))
        return (rank > 4) & (_size() > 200), new

    return _recent(rule)(df)


def recency_window(df: DataFrame, window: int = 6) -> DataFrame:
    """Negative control: user messages between the first two and the last ones become stubs."""
    w = Window.partitionBy("req_id")
    place = F.row_number().over(w.orderBy("idx"))
    marked = df.withColumn("_i", place).withColumn("_n", F.count(F.lit(1)).over(w))
    middle = (F.col("_n") > window + 2) & (F.col("_i") > 2) & (F.col("_i") <= F.col("_n") - window) & (F.col("role") == "user")
    return marked.withColumn("text", F.when(middle, "[earlier turn dropped by recency window]").otherwise(_text())).drop("_i", "_n")


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def dedup_exact(text: str) -> Transform:
    """An observation of 200 characters or more that repeats an earlier one points to it."""
    parts = text.split("{}")

    def run(df: DataFrame) -> DataFrame:
        counts = F.col("is_obs") & (_size() >= 200)
        first = F.min(F.when(counts, F.col("idx"))).over(Window.partitionBy("req_id", F.sha2("text", 256)))
        new = F.concat(F.lit(parts[0]), _s(F.col("_f")), F.lit(parts[1]), *((_s(_size()), F.lit(parts[2])) if len(parts) > 2 else ()))
        return _set(df.withColumn("_f", first), (_size() >= 200) & (F.col("_f") < F.col("idx")), new).drop("_f")

    return run


def _previous(df: DataFrame) -> DataFrame:
    return df.withColumn("_prev", F.coalesce(F.lag("text").over(Window.partitionBy("req_id").orderBy("idx")), F.lit("")))


def stale_read(df: DataFrame) -> DataFrame:
    path = F.when(F.col("is_obs"), F.nullif(F.regexp_extract("_prev", READ_PATH, 1), F.lit("")))
    marked = _previous(df).withColumn("_p", path)
    marked = marked.withColumn("_last", F.max("idx").over(Window.partitionBy("req_id", "_p")))
    new = F.concat(F.lit("[stale view of "), F.col("_p"), F.lit("; superseded by a later read/edit at step "), _s(F.col("_last")), F.lit("]"))
    return _set(marked, F.col("_p").isNotNull() & (F.col("_last") > F.col("idx")) & (_size() > 200), new).drop("_prev", "_p", "_last")


def search_head(df: DataFrame, k: int = 20) -> DataFrame:
    ls = F.split(F.regexp_replace(_text(), r"\n$", ""), r"\r\n|\n|\r", -1)
    new = F.concat(F.array_join(F.slice(ls, 1, k), "\n"), F.lit("\n…["), _s(F.size(ls) - k), F.lit(" more result lines elided]"))
    return _set(_previous(df), F.col("_prev").rlike(SEARCH_COMMAND) & (F.size(ls) > k + 5), new).drop("_prev")


def build_collapse(df: DataFrame) -> DataFrame:
    when = F.col("_prev").rlike(BUILD_COMMAND) & (_size() >= 400) & ~_any(F.lower(_text()), BUILD_FAILURES)
    return _set(_previous(df), when, F.concat(F.lit("[build/env step succeeded; "), _s(_size()), F.lit(" chars of log elided]"))).drop("_prev")


def _smart(least: int, few: int, block: Callable[[], tuple[Column, Column]], head: int, errors: int, tail: int, marks: tuple[str, ...], always: bool) -> Transform:
    def rule() -> tuple[Column, Column]:
        ls = F.split(_text(), "\n", -1)
        found = F.slice(F.filter(ls, lambda x: _any(x, marks)), 1, errors)
        middle = F.array(F.lit("...[middle elided]..."))
        middle = middle if always else F.when(F.size(ls) > 10, middle).otherwise(F.array().cast("array<string>"))
        kept = F.array_join(F.concat(F.slice(ls, 1, head), middle, found, F.slice(ls, -tail, tail)), "\n")
        applies, short = block()
        return _size() > least, F.when(F.size(ls) <= few, F.when(applies, short).otherwise(_text())).otherwise(F.when(F.length(kept) < _size(), kept).otherwise(_text()))

    return _content(rule)


smart = _smart(600, 12, lambda: (_size() > 1200, F.concat(_first(700), F.lit("\n...["), _s(_size() - 1000), F.lit(" elided]...\n"), _last(300))), 6, 8, 4, SMART_MARKS, False)
smart_gentle = _smart(3000, 20, lambda: (F.lit(True), F.concat(_first(1800), F.lit("\n...["), _s(_size() - 2400), F.lit(" elided]...\n"), _last(600))), 12, 10, 6, GENTLE_MARKS, True)


def squeeze(df: DataFrame) -> DataFrame:
    new = F.regexp_replace(F.regexp_replace(_text(), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return _set(df, (_size() >= 200) & (F.length(new) < _size()), new)


def retrieval_reference(df: DataFrame) -> DataFrame:
    ls = F.split(_text(), "\n", -1)
    short = F.concat(_first(3000), F.lit("\n[... "), _s(_size() - 3500), F.lit(" chars elided; re-run the command to see full output ...]\n"), _last(500))
    long = F.concat(F.array_join(F.slice(ls, 1, 30), "\n"), F.lit("\n[... "), _s(F.size(ls) - 45), F.lit(" lines elided ("), _s(_size()), F.lit(" chars total); re-read file/re-run to see full ...]\n"), F.array_join(F.slice(ls, -15, 15), "\n"))
    return _set(df, _size() > 5000, F.when(F.size(ls) < 50, short).otherwise(long))


def signal_lines(df: DataFrame) -> DataFrame:
    """Lines with a signal; a run of others is one ellipsis; blank lines stay outside runs."""
    ls = F.split(_text(), "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("dropping"))

    def step(acc: Column, line: Column) -> Column:
        keep = line.rlike(SIGNAL) | ((strip(line) == "") & ~acc["dropping"])
        more = F.when(keep, F.array(line)).when(acc["dropping"], F.array().cast("array<string>")).otherwise(F.array(F.lit("  ...")))
        return F.struct(F.concat(acc["kept"], more).alias("kept"), (~keep).alias("dropping"))

    new = F.aggregate(ls, start, step, lambda acc: F.array_join(acc["kept"], "\n"))
    marked = df.withColumn("_new", F.when(F.col("is_obs") & (_size() > 2000) & (F.size(ls) >= 20), new))
    return _set(marked, F.col("_new").isNotNull() & (F.length("_new") < _size() * 0.85), F.col("_new")).drop("_new")


def line_dedup(df: DataFrame) -> DataFrame:
    """Drop lines of 12 characters or more that stand earlier, in any observation of the
    request; short observations only count as having been seen; more than 3 must go."""
    e = df.where("is_obs").select("req_id", "idx", "text", F.posexplode(F.split(_text(), "\n", -1)).alias("no", "line")).withColumn("key", strip(F.col("line")))
    seen = F.row_number().over(Window.partitionBy("req_id", "key").orderBy("idx", "no")) > 1
    marked = e.withColumn("drop", seen & (F.length("key") >= 12))
    per = marked.groupBy("req_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("no", "line")))), lambda x: x["line"]), "\n").alias("kept"), F.count_if("drop").alias("dropped"))
    joined = df.join(per, ["req_id", "idx"], "left")
    new = F.concat("kept", F.lit("\n["), _s(F.col("dropped")), F.lit(" duplicate lines elided]"))
    return _set(joined, (_size() >= 300) & (F.col("dropped") > 3), new).drop("kept", "dropped")


def dedup_similar(df: DataFrame) -> DataFrame:
    """Observations whose common prefix and suffix with an earlier kept one cover over nine
    tenths; order-dependent, so a request is handled as a group (a request is bounded)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx").reset_index(drop=True)
        seen: list[tuple[int, str]] = []
        for i, (idx, text, obs) in enumerate(zip(group["idx"], group["text"], group["is_obs"], strict=True)):
            if not obs or len(text) < 200:
                continue
            for at, other in seen:
                if abs(len(text) - len(other)) > len(text) * 0.15:
                    continue
                if (_prefix(text, other) + min(_prefix(text[::-1], other[::-1]), max(0, min(len(text), len(other)) // 2 - 1))) / len(text) > 0.9:
                    group.loc[i, "text"] = f"[~identical to observation at step {at}; {len(text)} chars]"
                    break
            else:
                seen.append((idx, text))
        return group

    return df.groupBy("req_id").applyInPandas(run, df.schema)


def _prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    return low


def segment_dedup(df: DataFrame) -> DataFrame:
    """Only the newest observation: its lines that stand in earlier observations go."""
    newest = _recency(df).withColumn("newest", F.col("is_obs") & (F.col("obs_rank") == 1)).drop("obs_rank", "n_obs")
    e = newest.where("is_obs").select("req_id", "idx", "newest", F.posexplode(F.split(_text(), "\n", -1)).alias("no", "line")).withColumn("key", strip(F.col("line")))
    before = F.max((~F.col("newest")).cast("int")).over(Window.partitionBy("req_id", "key")) == 1
    marked = e.withColumn("drop", before & (F.length("key") >= 12)).where("newest")
    per = marked.groupBy("req_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("no", "line")))), lambda x: x["line"]), "\n").alias("kept"), F.count_if("drop").alias("dropped"))
    joined = newest.join(per, ["req_id", "idx"], "left")
    new = F.concat("kept", F.lit("\n["), _s(F.col("dropped")), F.lit(" duplicate lines elided]"))
    return _set(joined, F.col("newest") & (F.col("dropped") > 0), new).drop("newest", "kept", "dropped")


def compose(*steps: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


_old = window_clear(8, 300, "[earlier tool observation cleared (context editing); {} chars]")
_pointer = dedup_exact("[identical to the observation at step {}]")
_stable = dedup_exact("[identical to earlier observation #{}; {} chars]")
_obs_cap = lambda n: cap(n, "\n…[{} chars elided; head+tail kept]…\n")

METHODS: dict[str, Transform] = {
    "C0_identity": lambda df: df,
    "M1_dedup_exact": _pointer,
    "M2_stale_read_elide": stale_read,
    "M3_obs_cap_10k": _obs_cap(10_000),
    "M4_obs_cap_5k": _obs_cap(5_000),
    "M5_search_head": search_head,
    "M6_env_log_collapse": build_collapse,
    "M7_old_obs_elide": _old,
    "CNEG_recency": recency_window,
    "AGG1_recency_obs_12": window_clear(12),
    "AGG2_recency_obs_8": window_clear(8),
    "AGG3_recency_obs_4": window_clear(4),
    "BRUTAL1_window_2": window_clear(2),
    "BRUTAL2_window_1": window_clear(1),
    "COMBO1_m7_cap5k": compose(_old, _obs_cap(5_000)),
    "COMBO2_m7_dedup": compose(_old, _pointer),
    "SUM1_summarize_old": summarize_old,
    "COMP1_tool_compress": _content(lambda: (_size() > 2000, F.concat(_first(1000), F.lit("\n...["), _s(_size() - 1500), F.lit(" chars compressed]...\n"), _last(500)))),
    "HYBRID1_m7_agg2": hybrid,
    "DEDUP2_similar_obs": dedup_similar,
    "PROG1_progressive": progressive,
    "NUKE_all_obs": _content(lambda: (_size() > 50, F.lit("[observation cleared]"))),
    "ERR_ONLY_keep_errors": _content(lambda: ((_size() > 200) & ~_any(F.lower(_text()), ERROR_WORDS), F.lit("[success observation cleared; errors preserved]"))),
    "SUM_ALL_summarize": _content(lambda: (_size() > 500, F.concat(_first(150), F.lit("..."), _last(80), F.lit(" ["), _s(_size()), F.lit("c]")))),
    "HALF_context": _content(lambda: (_size() > 400, F.substring(_text(), F.floor(_size() / 2).cast("int") + 1, _size()))),
    "CAP2K_stable": cap(2000),
    "CAP1K_stable": cap(1000),
    "CAP800_stable": cap(800),
    "CAP500_stable": cap(500),
    "SMART_stable": smart,
    "DEDUPS_stable": _stable,
    "COMBOCD_stable": compose(_stable, cap(1000)),
    "COMBOSC_stable": compose(smart, cap(1200)),
    "GENTLE4K_stable": cap(4000),
    "GENTLE6K_stable": cap(6000),
    "SMARTGENTLE_stable": smart_gentle,
    "LINEDEDUP_e4": line_dedup,
    "SQUEEZE_e4": squeeze,
    "RETRIEVREF_e4": retrieval_reference,
    "SIGNAL_e4": signal_lines,
    "COMBOSS_e4": compose(squeeze, signal_lines),
}


def apply_method(df: DataFrame, name: str) -> DataFrame:
    """The named transform; an unknown name leaves the messages as they are."""
    return METHODS.get(name, METHODS["C0_identity"])(df)


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Characters before and after, changed rows, and the first of them, by request."""
    b = before.select("req_id", "idx", F.length("text").alias("b"), F.xxhash64("text").alias("hb"))
    a = after.select("req_id", "idx", F.length("text").alias("a"), F.xxhash64("text").alias("ha"))
    j = b.join(a, ["req_id", "idx"]).withColumn("c", F.col("hb") != F.col("ha"))
    return j.groupBy("req_id").agg(F.sum("b").alias("chars_before"), F.sum("a").alias("chars_after"), F.count_if("c").alias("changed"), F.min(F.when(F.col("c"), F.col("idx"))).alias("first_changed"), F.floor((F.sum("b") - F.sum("a")) / 4).alias("tokens_saved"))
