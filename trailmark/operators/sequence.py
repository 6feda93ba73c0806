"""Operators over ordered events of a trace.

Each takes a long table with a key and an order column and costs one shuffle by the
key; several on the same key share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def _all(key: str) -> Window:
    return Window.partitionBy(key)


def first_index(df: DataFrame, key: str, order: str, **predicates: Column) -> DataFrame:
    """The first index at which each predicate holds, null if none."""
    return df.groupBy(key).agg(*(F.min(F.when(p, F.col(order))).alias(name) for name, p in predicates.items()))


def type_switches(df: DataFrame, key: str, order: str, kind: str, ignore: tuple[str, ...] = ("PLAN", "OTHER")) -> DataFrame:
    """Changes of type between neighbours, without the ignored types."""
    kept = df.where(~F.col(kind).isin(*ignore))
    before = F.lag(kind).over(_w(key, order))
    return kept.select(key, (before != F.col(kind)).cast("int").alias("s")).groupBy(key).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("switches"))


def runs(df: DataFrame, key: str, order: str, predicate: Column) -> DataFrame:
    """key, start, length of each maximal run of rows for which the predicate holds."""
    w = _w(key, order)
    numbered = df.select(key, F.col(order).alias("_o"), predicate.alias("_p"), F.row_number().over(w).alias("_n"))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    return numbered.where("_p").withColumn("_i", island).groupBy(key, "_i").agg(F.min("_o").alias("start"), F.count(F.lit(1)).alias("length")).drop("_i")


def longest_run(df: DataFrame, key: str, order: str, predicate: Column, name: str = "longest") -> DataFrame:
    """Length of the longest run of each key, 0 if the predicate never holds."""
    found = runs(df, key, order, predicate).groupBy(key).agg(F.max("length").alias(name))
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def is_first(key: str, order: str, value: str) -> Column:
    """Is this the value's first row in its trace?  A null value is never new."""
    return F.col(value).isNotNull() & (F.row_number().over(Window.partitionBy(key, value).orderBy(order)) == 1)


def no_new_evidence(df: DataFrame, key: str, order: str, *values: str, name: str = "longest") -> DataFrame:
    """Longest streak of rows that bring no value not seen before in any of the columns."""
    new = F.lit(False)
    for v in values:
        df = df.withColumn(f"_new_{v}", is_first(key, order, v))
        new = new | F.col(f"_new_{v}")
    return longest_run(df.withColumn("_old", ~new), key, order, F.col("_old"), name)


def novelty(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of rows that bring a new value, and the number of repeats."""
    return df.groupBy(key).agg((F.count_distinct(value) / F.count(F.lit(1))).alias("novel_rate"), (F.count(value) - F.count_distinct(value)).alias("repeats"))


def reversions(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Visits of a value beyond its first, after equal neighbours are collapsed."""
    before = F.lag(value).over(_w(key, order))
    changes = df.where(F.col(value).isNotNull()).withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(value)))
    return changes.groupBy(key).agg((F.count(F.lit(1)) - F.count_distinct(value)).alias("reversions"))


def retries(df: DataFrame, key: str, value: str, failed: Column) -> DataFrame:
    """Failed rows whose value occurs more than once in the trace."""
    n = F.count(value).over(Window.partitionBy(key, value))
    return df.select(key, (failed & (n > 1)).cast("long").alias("r")).groupBy(key).agg(F.sum("r").alias("retries"))


def reads_again(df: DataFrame, key: str, order: str, target: str, is_read: Column) -> DataFrame:
    """Reads of a target that was read before, and reads of one that is read later."""
    reads = df.where(is_read & F.col(target).isNotNull())
    w = Window.partitionBy(key, target)
    marked = reads.select(key, (F.row_number().over(w.orderBy(order)) > 1).cast("long").alias("again"), (F.max(order).over(w) > F.col(order)).cast("long").alias("later"))
    return marked.groupBy(key).agg(F.sum("again").alias("re_reads"), F.sum("later").alias("read_later"))


def expansion(df: DataFrame, key: str, order: str, value: str, is_search: Column) -> DataFrame:
    """Searches, and those that find nothing that an earlier search has not found."""
    s = df.where(is_search)
    first = F.min(order).over(Window.partitionBy(key, value))
    return s.select(key, (first < F.col(order)).cast("long").alias("stale")).groupBy(key).agg(F.count(F.lit(1)).alias("searches"), F.sum("stale").alias("no_expansion"))


def re_edits(df: DataFrame, key: str, order: str, target: str, is_edit: Column, is_evidence: Column) -> DataFrame:
    """Edits of a target whose last edit no evidence row stands between."""
    w = _w(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_seen", F.sum(is_evidence.cast("int")).over(w)).where(is_edit)
    before = F.lag("_seen").over(Window.partitionBy(key, target).orderBy(order))
    return marked.select(key, F.coalesce((before == F.col("_seen")).cast("long"), F.lit(0)).alias("r")).groupBy(key).agg(F.count(F.lit(1)).alias("edits"), F.sum("r").alias("no_evidence_re_edits"))


def post_edit_gap(df: DataFrame, key: str, order: str, is_edit: Column, is_test: Column) -> DataFrame:
    """Tests after the last edit and the gap to the first of them (null if there is none)."""
    last = F.max(F.when(is_edit, F.col(order))).over(_all(key))
    after = df.withColumn("_last", last).withColumn("_t", is_test & (F.col(order) > F.col("_last")))
    return after.groupBy(key).agg(F.max("_last").alias("last_edit"), F.sum(F.col("_t").cast("long")).alias("tests_after"), F.min(F.when(F.col("_t"), F.col(order) - F.col("_last"))).alias("gap"))


def meaningful_prefix(df: DataFrame, key: str, order: str, k: int, meaningful: Column) -> DataFrame:
    """Rows up to the k-th meaningful one; the rows between ride along; k = 0 is empty."""
    before = _w(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.coalesce(F.sum(meaningful.cast("int")).over(before), F.lit(0))).where(F.col("_m") < k).drop("_m")


def firewall(df: DataFrame, hide: tuple[str, ...], drop: tuple[str, ...]) -> DataFrame:
    """A prefix view without what the future would tell: hidden columns null, others gone."""
    return df.drop(*drop).withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hide if c in df.columns})


def next_pairs(df: DataFrame, key: str, order: str, role: str, text: str, first: str, second: str) -> DataFrame:
    """Each row of role ``first`` with the text of the next row, if that is of ``second``."""
    w = _w(key, order)
    after = df.withColumn("_r", F.lead(role).over(w)).withColumn("_t", F.lead(text).over(w))
    return after.where(F.col(role) == first).select(key, order, F.col(text).alias("action"), F.when(F.col("_r") == second, F.col("_t")).alias("observation"))


def horizon(df: DataFrame, key: str, order: str, is_start: Column, value: str, rows: int = 3) -> DataFrame:
    """Sum of ``value`` over the first start row and the next ones, ``rows`` at most."""
    start = F.min(F.when(is_start, F.col(order))).over(_all(key))
    later = df.withColumn("_s", start).where(F.col(order) >= F.col("_s"))
    taken = later.withColumn("_n", F.row_number().over(_w(key, order))).where(F.col("_n") <= rows)
    return taken.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("taken"), (F.count(F.lit(1)) < rows).alias("truncated"))


def upper_quantiles(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Median (upper), ninth decile and maximum as elements of the sorted values."""
    s = df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("s"), F.count(value).alias("n"))
    at = lambda share: F.element_at("s", (F.floor(F.col("n") * share) + 1).cast("int"))
    return s.where("n > 0").select(key, at(0.5).alias("median"), at(0.9).alias("p90"), F.element_at("s", -1).alias("largest"))


def matched_prefix(df: DataFrame, key: str, order: str, changed: Column) -> DataFrame:
    """The first changed call and the number of calls before it."""
    first = F.min(F.when(changed, F.col(order))).over(_all(key))
    return df.withColumn("_f", first).groupBy(key).agg(F.max("_f").alias("first_divergence"), F.sum((F.col("_f").isNull() | (F.col(order) < F.col("_f"))).cast("long")).alias("matched_prefix"))


def lines(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row for each line: key, order, line_no (from 0), line and its stripped form."""
    e = df.select(key, order, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return e.withColumn("stripped", F.regexp_replace("line", r"^\s+|\s+$", ""))


def duplicate_lines(df: DataFrame, key: str, order: str, text: str, least: int = 12) -> DataFrame:
    """Of each row's eligible lines, how many stand in earlier rows of the key."""
    e = lines(df, key, order, text).where(F.length("stripped") >= least)
    first = F.min(order).over(Window.partitionBy(key, "stripped"))
    marked = e.select(key, order, (first < F.col(order)).cast("long").alias("d"))
    return marked.groupBy(key, order).agg(F.count(F.lit(1)).alias("eligible"), F.sum("d").alias("duplicates"), (F.sum("d") / F.count(F.lit(1))).alias("share"))


def duplicate_spans(df: DataFrame, key: str, text: str, least: int = 12) -> DataFrame:
    """Spans of consecutive lines that repeat earlier lines of the same text: their
    number, the longest, and the mean relative place of the repeated lines."""
    e = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"), F.size(F.split(text, "\n", -1)).alias("n")).withColumn("s", F.regexp_replace("line", r"^\s+|\s+$", ""))
    again = (F.length("s") >= least) & (F.row_number().over(Window.partitionBy(key, "s").orderBy("line_no")) > 1)
    d = e.withColumn("again", again).where("again")
    island = d.withColumn("i", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    spans = island.groupBy(key, "i").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("line_no") / F.col("n")).alias("p"))
    return spans.groupBy(key).agg(F.count(F.lit(1)).alias("spans"), F.max("k").alias("longest"), F.sum("k").alias("duplicates"), (F.sum("p") / F.sum("k")).alias("mean_place"))


def recurrence(df: DataFrame, key: str, order: str, entity: str, text: str, back: int = 3) -> DataFrame:
    """Does the entity stand in one of the last ``back`` texts before the row?"""
    before = F.collect_list(text).over(_w(key, order).rowsBetween(-back, -1))
    return df.withColumn("_b", before).select(key, order, F.exists("_b", lambda t: F.contains(t, F.col(entity))).alias("recurs"))


def oversized_then_narrow(df: DataFrame, key: str, order: str, size: str, limit: float, ahead: int = 4) -> DataFrame:
    """Oversized rows with a smaller one among the next ``ahead``."""
    after = F.collect_list(size).over(_w(key, order).rowsBetween(1, ahead))
    marked = df.withColumn("_a", after).where(F.col(size) >= limit)
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("oversized"), F.sum(F.exists("_a", lambda s: s < limit).cast("long")).alias("narrowed"))


def trace_features(df: DataFrame, key: str = "trace_id", order: str = "event_index", kind: str = "etype", args: str = "args_hash") -> DataFrame:
    """A wide feature row for each trace; all windows share the shuffle by key."""
    w = _w(key, order)
    seen = df.withColumn("_b", F.lag(kind).over(w)).withColumn("_c", F.count(args).over(Window.partitionBy(key, args)))
    is_ = lambda t: F.col(kind) == t
    return seen.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(is_("SEARCH")).alias("searches"), F.count_if(is_("READ")).alias("reads"), F.count_if(is_("EDIT")).alias("edits"),
        F.count_if(is_("TEST")).alias("tests"), F.count_if(is_("TOOL_ERROR")).alias("errors"), F.min(F.when(is_("SEARCH"), F.col(order))).alias("first_search"),
        F.min(F.when(is_("EDIT"), F.col(order))).alias("first_edit"), F.min(F.when(is_("TEST"), F.col(order))).alias("first_test"),
        F.coalesce(F.sum((F.col("_b") != F.col(kind)).cast("long")), F.lit(0)).alias("switches"), (F.count(args) - F.count_distinct(args)).alias("duplicate_calls"),
        F.count_if(is_("TOOL_ERROR") & (F.col("_c") > 1)).alias("retries"),
    )


def recurrence_by_kind(df: DataFrame, key: str, order: str, entity: str, is_plan: Column, plans: int = 2, outputs: int = 3) -> DataFrame:
    """Does the entity stand in the last ``plans`` plans before the row, or in the last
    ``outputs`` other rows?

    Each row's own number among plans and among outputs places it in a window of a few rows."""
    w = _w(key, order)
    marked = df.withColumn("_p", is_plan)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = marked.withColumns({"_np": F.coalesce(F.count_if("_p").over(before), F.lit(0)), "_no": F.coalesce(F.count_if(~F.col("_p")).over(before), F.lit(0))})
    last = lambda own, count, k: F.max(F.when(own, F.col(count))).over(Window.partitionBy(key, entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)) >= F.col(count) - k
    seen_plan, seen_output = last(F.col("_p"), "_np", plans), last(~F.col("_p"), "_no", outputs)
    return n.select(key, order, F.coalesce(seen_plan & F.col(entity).isNotNull(), F.lit(False)).alias("in_plans"), F.coalesce(seen_output & F.col(entity).isNotNull(), F.lit(False)).alias("in_outputs"))


def stagnation(df: DataFrame, key: str, order: str, result: str, files: str) -> DataFrame:
    """Rows without evidence: the result was seen before and no file is new.  The longest
    run of them in each trace, and their share of its rows."""
    w = _w(key, order)
    f = df.select(key, order, F.explode(files).alias("_file")).distinct()
    new = f.withColumn("_first", F.row_number().over(Window.partitionBy(key, "_file").orderBy(order)) == 1).groupBy(key, order).agg(F.bool_or("_first").alias("_new"))
    seen = F.row_number().over(Window.partitionBy(key, result).orderBy(order)) > 1
    r = df.select(key, order, result).join(new, [key, order], "left").withColumn("_stale", seen & ~F.coalesce("_new", F.lit(False)))
    r = r.withColumn("_run", F.count_if(~F.col("_stale")).over(w))
    runs = r.groupBy(key, "_run").agg(F.count_if("_stale").alias("stale"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("stale").alias("longest"), (F.sum("stale") / F.sum("n")).alias("fraction"))
