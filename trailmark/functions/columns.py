"""Scalar column functions: classification, extraction, hashing, costs, bounds.

All are built from built-in expressions, so they stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Leading verbs of an agent's own commands and the event types they mean.
NATIVE_VERBS = {
    "create": "EDIT", "edit": "EDIT", "insert": "EDIT", "append": "EDIT", "str_replace": "EDIT",
    "open": "READ", "goto": "READ", "scroll_up": "READ", "scroll_down": "READ", "scroll": "READ",
    "search_file": "SEARCH", "search_dir": "SEARCH", "find_file": "SEARCH", "grep": "SEARCH",
    "submit": "FINISH", "exit": "FINISH", "exit_forfeit": "FINISH", "exit_cost": "FINISH",
}
#: Patterns of shell commands, in order of precedence.
WRITE = r"(?i)(<<\s*['\"]?[A-Za-z_]+['\"]?|cat\s*>|\btee\b|\bstr_replace\b|\bsed -i\b|\becho\b[^|]*>\s*[\w./]+\.\w+|>\s*[\w./]+\.\w{1,6}\b)"
ENVIRONMENT = r"(?i)(pip install|pip3 install|conda |apt-get|python setup\.py|setup\.py|make install|\bmake\b|cmake|\bexport \w+=|^\s*source |^\s*cd /|docker|podman|requirements\.txt|build_ext|\.\/configure)"
TEST = r"(?i)(\bpytest\b|\btox\b|\bunittest\b|py\.test|nosetests|python -m pytest|python -m unittest|/tests?/|run_tests)"
PATCH = r"(?i)\b(git apply|patch -p|git commit|git checkout -- |apply_patch|git diff)\b"
SEARCH = r"(?i)\b(grep|rg|ag|git grep|ack|locate|fgrep|egrep)\b|(?<!\w)find\b"
READ = r"(?i)^(cat|head|tail|less|view|nl|more)\b|\bsed -n|\bwc -l"
RETRIEVE = r"(?i)\b(retrieve|recall|memory_search|vector|embed)\b"
#: The clean-room classifier's verbs and patterns (tests come before writes there).
CLEAN_VERBS = {
    "create": "EDIT", "edit": "EDIT", "insert": "EDIT", "append": "EDIT", "str_replace": "EDIT",
    "submit": "SUBMIT", "exit": "SUBMIT", "exit_forfeit": "SUBMIT", "exit_cost": "SUBMIT", "exit_command_timeout": "SUBMIT",
    "open": "READ", "goto": "READ", "scroll_up": "READ", "scroll_down": "READ", "scroll": "READ",
    "search_file": "SEARCH", "search_dir": "SEARCH", "find_file": "SEARCH",
}
CLEAN_TEST = r"(?i)\b(pytest|tox|py\.test|nosetests|unittest|run_tests?|python -m pytest|python -m unittest)\b"
CLEAN_ENV = r"(?i)(pip install|pip3 install|conda install|conda create|apt-get|python setup\.py|setup\.py (install|build|develop)|make install|\bmake\b|cmake|\./configure|build_ext|export [A-Z_]+=|virtualenv|\bpoetry (install|add)\b)"
CLEAN_SEARCH = r"(?i)\b(grep|rg|ag|git grep|ack|egrep|fgrep|locate)\b|(?<![\w-])find\b"
CLEAN_WRITE = r"(<<\s*['\"]?[A-Za-z_]+|cat\s*>|\btee\b|\bsed -i\b|>>?\s*[\w./-]+\.\w{1,6}\b)"
CLEAN_READ = r"(?i)^\s*(cat|head|tail|less|more|view|nl|sed -n|wc\b|ls\b|tree\b)"
CLEAN_GIT = r"(?i)\b(git diff|git apply|git status|git log|patch -p)\b"
EDITOR_WRITES = r"\b(str_replace|create|insert|write|edit|old_str|new_str)\b"
#: Markers of an erroneous observation, the first found names the error.
ERROR_MARKERS = (
    "traceback (most recent call last)", "command not found", "no such file", "error:", "permission denied", "syntaxerror",
    "modulenotfounderror", "importerror", "exit code 1", "returncode>1", "fatal:", "cannot ",
)
#: Strong signs of an error.
STRONG_ERRORS = (
    r"(?i)(<returncode>\s*[1-9]\d*\s*</returncode>|exit code:\s*[1-9]\d*|returncode=\s*[1-9])",
    r"Traceback \(most recent call last\)",
    r"(^|\n)\s*(bash:|/bin/sh:|.*: command not found|.*: No such file or directory|fatal:)",
    r"(^|\n)\s*([A-Z][a-zA-Z]*Error|Exception|ERROR)\b\s*:",
    r"(^|\n)E\s{2,}\w",
)
EMPTY_RESULT = r"(no matches|not found|no such file|0 results|nothing|no files? found|command not found)"
TRUNCATED = r"(?i)(\.\.\.\s*\(?truncated|output truncated|\[truncated\]|too long|lines? omitted|<response clipped>)"
PATHS = r"(?:\.?/)?(?:[\w.\-]+/){1,}[\w.\-]+\.\w{1,6}"
CLEAN_PATHS = r"(?:^|[\s'\"=(])(/?[\w./-]+\.[A-Za-z]{1,5})\b"
CLEAN_EXTENSIONS = r"\.(py|txt|cfg|toml|ini|rst|md|json|yaml|yml|c|h|cpp|js)$"
MOST_PATHS = 25
OVERSIZED_CHARS = 8000
#: Weights of input, cache read, cache creation and output tokens.
COST_WEIGHTS = (1.0, 0.1, 1.25, 5.0)
#: z of a one-sided 95 % bound and of a two-sided 95 % interval.
Z_ONE_SIDED, Z_TWO_SIDED = 1.645, 1.96
# ----------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_space(x: Column) -> Column:
    """Each run of white space as one blank, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def content_hash(x: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of SHA-256; null stays null."""
    return F.substring(F.sha2(x, 256), 1, length)


def clean_hash(x: Column) -> Column:
    return F.substring(F.sha1(normalize_space(x)), 1, 12)


def classify_command(command: Column, thought: Column | None = None) -> Column:
    """The event type of a shell action; the first rule that matches decides."""
    has_thought = (F.coalesce(thought, F.lit("")) != "") if thought is not None else F.lit(False)
    c = strip(command)
    native = _lookup(F.lower(F.regexp_extract(c, r"^[^\s:]*", 0)), NATIVE_VERBS)
    return (
        F.when(F.coalesce(command, F.lit("")) == "", F.when(has_thought, "PLAN").otherwise("OTHER"))
        .when(native.isNotNull(), native)
        .when(c.rlike(WRITE), "EDIT").when(c.rlike(ENVIRONMENT), "ENVIRONMENT").when(c.rlike(TEST), "TEST").when(c.rlike(PATCH), "PATCH_APPLY")
        .when(c.rlike(SEARCH), "SEARCH").when(c.rlike(READ), "READ").when(c.rlike(RETRIEVE), "RETRIEVE").otherwise("EXECUTE")
    )


def classify_clean(action: Column, tool: Column | None = None, args: Column | None = None) -> Column:
    """struct(cls, evidence) of the clean-room classifier."""
    raw = strip(F.coalesce(action, F.lit("")))
    tool = F.lower(strip(F.coalesce(tool, F.lit("")))) if tool is not None else F.lit("")
    text = F.coalesce(F.when(args != "", args), raw) if args is not None else raw
    is_bash = tool.isin("execute_bash", "execute_ipython_cell")
    raw = F.when(is_bash, text).otherwise(raw)
    low = F.lower(text)
    words = F.split(raw, r"\s+")
    lead, sub = F.lower(F.get(words, F.lit(0))), F.lower(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    native = _lookup(lead, CLEAN_VERBS)
    out = lambda cls, why: F.struct((F.lit(cls) if isinstance(cls, str) else cls).alias("cls"), (F.lit(why) if isinstance(why, str) else why).alias("evidence"))
    writes = low.rlike(EDITOR_WRITES)
    return (
        F.when(tool == "finish", out("SUBMIT", "tool=finish"))
        .when(tool.isin("str_replace_editor", "file_editor"), F.when(writes, out("EDIT", F.concat(F.lit("tool="), tool, F.lit("/edit")))).when(low.rlike(r"\b(view|read)\b"), out("READ", F.concat(F.lit("tool="), tool, F.lit("/view")))).otherwise(out("READ", F.concat(F.lit("tool="), tool, F.lit("/ambiguous->read")))))
        .when(native.isNotNull(), out(native, F.concat(F.lit("native:"), lead)))
        .when(lead.isin("str_replace_editor", "file_editor", "edit_file"), F.when(sub.isin("view", "open", "read"), out("READ", F.concat(F.lit("editor:"), sub))).when(sub.isin("str_replace", "create", "insert", "append", "write", "edit"), out("EDIT", F.concat(F.lit("editor:"), sub))).otherwise(out("READ", "editor:ambiguous->read")))
        .when(text.rlike(CLEAN_TEST), out("TEST", "re:test")).when(text.rlike(CLEAN_WRITE), out("EDIT", "re:write")).when(text.rlike(CLEAN_ENV), out("ENV", "re:env"))
        .when(text.rlike(CLEAN_SEARCH), out("SEARCH", "re:search")).when(text.rlike(CLEAN_READ), out("READ", "re:read")).when(text.rlike(CLEAN_GIT), out("EXEC_OTHER", "re:gitdiff"))
        .when(raw == "", out("OTHER", "empty")).otherwise(out("EXEC_OTHER", "fallthrough"))
    )


def error_marker(observation: Column) -> Column:
    """The first marker found, up to its colon or '>'; null if there is none."""
    low = F.lower(observation)
    out = None
    for marker in ERROR_MARKERS:
        label = marker.split(":")[0].split(">")[0].strip()
        out = (F.when if out is None else out.when)(F.contains(low, F.lit(marker)), label)
    return out


def is_error(observation: Column) -> Column:
    """Strong signs only; null and blank observations are none."""
    o = F.coalesce(observation, F.lit(""))
    found = F.lit(False)
    for pattern in STRONG_ERRORS:
        found = found | o.rlike(pattern)
    return found & (strip(o) != "")


def test_result(observation: Column) -> Column:
    low = F.lower(observation)
    good = F.contains(low, F.lit("passed")) | low.rlike(r"\bok\b")
    bad = F.contains(low, F.lit("failed")) | F.contains(low, F.lit("error"))
    return F.when(observation.isNull(), None).when(good & bad, "MIXED").when(bad, "FAIL").when(good, "PASS").otherwise("UNKNOWN")


def event_type(command: Column, thought: Column | None, observation: Column) -> Column:
    """The command's type; an erroneous EXECUTE is a TOOL_ERROR."""
    kind = classify_command(command, thought)
    return F.when((kind == "EXECUTE") & error_marker(observation).isNotNull(), "TOOL_ERROR").otherwise(kind)


def paths(text: Column) -> Column:
    """Distinct file paths in order of appearance, 25 at most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATHS), F.lit(0))), 1, MOST_PATHS)


def clean_paths(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLEAN_PATHS), F.lit(1))
    kept = F.filter(found, lambda p: ((F.length(p) > 3) & F.contains(p, F.lit("/"))) | p.rlike(CLEAN_EXTENSIONS))
    return F.transform(kept, lambda p: F.regexp_replace(p, "^/+", ""))


def query_signature(text: Column) -> Column:
    """Sorted distinct lower-case names of three letters or more, without the search verb."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*(grep|rg|ag|find|search_file|search_dir|find_file|git grep|egrep|fgrep)\b", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"[a-z_][a-z0-9_]{2,}"), F.lit(0))))


def is_empty_result(observation: Column) -> Column:
    o = F.lower(strip(F.coalesce(observation, F.lit(""))))
    return (o == "") | o.rlike(EMPTY_RESULT)


def is_oversized(observation: Column, chars: int = OVERSIZED_CHARS) -> Column:
    return F.coalesce(F.length(observation) >= chars, F.lit(False))


def is_truncated(observation: Column) -> Column:
    return F.coalesce(observation, F.lit("")).rlike(TRUNCATED)


def effective_cost(input_: Column, cache_read: Column, cache_creation: Column, output: Column, weights: tuple = COST_WEIGHTS) -> Column:
    """Weighted tokens; a ledger's missing counts are 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return sum((F.lit(w) * zero(c) for w, c in zip(weights[1:], (cache_read, cache_creation, output), strict=True)), F.lit(weights[0]) * zero(input_))


def wilson(successes: Column, n: Column, z: float, upper: bool = True) -> Column:
    """Wilson bound of a share; null without trials."""
    k, n = successes.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n))
    middle = p + F.lit(z * z / 2) / n
    return F.when(n > 0, (middle + half if upper else middle - half) / (1 + F.lit(z * z) / n))


def wilson_upper(successes: Column, n: Column) -> Column:
    """One-sided 95 % upper bound; 1 without trials."""
    return F.coalesce(F.least(wilson(successes, n, Z_ONE_SIDED), F.lit(1.0)), F.lit(1.0))


def risk_tier(regressions: Column, upper: Column) -> Column:
    return F.when(regressions == 0, "STRICT").when(upper <= 0.06, "LOW").when(upper <= 0.15, "MEDIUM").when(upper <= 0.30, "HIGH").otherwise("UNSAFE")


def redundancy_stratum(share: Column, duplicates: Column) -> Column:
    return F.when(share > 0.40, "HIGH_REDUNDANCY").when((share > 0) & (duplicates >= 5), "MIXED_REDUNDANCY").otherwise("NONE")


def verdict(baseline: Column, candidate: Column) -> Column:
    return F.when(baseline & ~candidate, "REGRESSION").when(~baseline & candidate, "IMPROVEMENT").when(baseline, "both_pass").otherwise("both_fail")


def tertile(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull() | low.isNull(), "na").when(x <= low, "low").when(x >= high, "high").otherwise("med")


def eligible_lines(text: Column, least: int = 12) -> Column:
    """Stripped lines of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: F.length(x) >= least)
