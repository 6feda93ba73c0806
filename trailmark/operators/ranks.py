"""Running totals, places and quantiles over a total order of all rows.

No task holds the whole order: a hashed sample of at most ``SAMPLE`` keys gives bounds
of ``PARTS`` parts, rows are ordered inside their part, and the parts' totals (a row
each) say what lies before a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, SAMPLE = 256, 16384  # parts are a power of two; broadcast: PARTS keys and PARTS totals


def running(df: DataFrame, order: list[str], amount: Column, name: str, by: tuple[str, ...] = (), whole: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows before a row, by ``order`` (nulls
    first); with ``by``, the first columns of ``order``, over those of its group alone.
    ``whole``: a column for the sum of the group.  Rows with equal keys share a part, so
    the keys should be nearly distinct."""
    key = F.struct(*order)
    # The hash reads the amount too, so that all three uses of an aggregated input are one exchange.
    sample = df.select(key.alias("_key"), F.xxhash64(key, amount).alias("_hash")).orderBy("_hash", "_key").limit(SAMPLE).agg(F.array_sort(F.collect_list("_key")).alias("_s"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / PARTS).cast("int")))
    steps = F.array(*(F.lit(PARTS >> i) for i in range(1, PARTS.bit_length())))
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= key, at + step).otherwise(at))
    dealt = df.join(F.broadcast(sample.select(cut.alias("_cuts")))).withColumn("_part", part).withColumn("_amount", amount).drop("_cuts")
    earlier = lambda w: F.coalesce(F.sum("_total" if w is of_group else "_amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_group = Window.partitionBy(*by).orderBy("_part")  # a group's parts; without groups PARTS rows
    totals = dealt.groupBy("_part", *by).agg(F.sum("_amount").alias("_total"))
    totals = totals.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)), earlier(of_group).alias("_before"), F.sum("_total").over(Window.partitionBy(*by)).alias("_whole"))
    placed = dealt.withColumn("_inside", earlier(Window.partitionBy("_part", *by).orderBy(*order)))
    same = [F.col("_part") == F.col("_p"), *(F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by))]
    placed = placed.join(totals if by else F.broadcast(totals), same).withColumn(name, F.col("_before") + F.col("_inside"))
    placed = placed.withColumnRenamed("_whole", whole) if whole else placed.drop("_whole")
    return placed.drop("_part", "_amount", "_p", "_before", "_inside", *(f"_g{i}" for i in range(len(by))))


def place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number, from 1, by ``order`` (nulls first)."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def sorted_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A row for each group's distinct value (not null): ``_v``, its count ``_n``, how many of the
    group's rows are less, ``_less``, and the group's rows, ``_rows``.  Frequent values are
    one row before anything is ordered."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return running(c, [*by, "_v"], F.col("_n"), "_less", tuple(by), "_rows")


def at(place: Column) -> Column:
    """Aggregate over ``sorted_counts``: the value at a place (from 0) of the group."""
    return F.max(F.when((F.col("_less") <= place) & (place < F.col("_less") + F.col("_n")), F.col("_v")))


def quantiles(df: DataFrame, by: list[str], value: str, **shares: float | Column) -> DataFrame:
    """Exact linear quantiles of each group, a column for each of ``shares``; a group
    without values has no row.  A share that is a column is another aggregate over
    ``sorted_counts``."""

    def linear(q: float) -> Column:
        h = F.lit(q) * (F.col("_rows") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        part = F.max(h - F.floor(h))
        return low + (high - low) * part

    return sorted_counts(df, by, value).groupBy(*by).agg(*((q if isinstance(q, Column) else linear(q)).alias(n) for n, q in shares.items()))


def mean() -> Column:
    """Aggregate over ``sorted_counts``: the mean of the group."""
    return F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")


def with_quantiles(df: DataFrame, measured: DataFrame, by: list[str], value: str, **shares: float) -> DataFrame:
    """``measured``, an aggregate of ``df`` by ``by``, with quantiles of ``value`` beside it."""
    q = quantiles(df, by, value, **shares)
    if not by:
        return measured.join(F.broadcast(q), how="left")
    q = q.withColumnsRenamed({b: f"_g{i}" for i, b in enumerate(by)})
    same = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    return measured.join(q, same, "left").drop(*(f"_g{i}" for i in range(len(by))))
