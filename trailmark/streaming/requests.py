"""Requests of an agent as trial events: features, gate, modes, outcomes.

The same frames work on a batch and, inside ``foreachBatch``, on a stream: what a
request shows (its own messages) needs no state; assignment is in ``trial``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import effective_cost
from ..operators import evidence
from ..operators.statistics import uniform

#: What is randomised or forced in each mode: (assignment or None for a draw, propensity).
MODES = {"randomize": (None, 0.5), "sham": (None, 0.5), "noop_only": ("NO_OP", 1.0), "dedup_only": ("LINEDEDUP", 1.0), "log_only": (None, None)}


def event_records(messages: DataFrame, known: DataFrame, key: str, order: str, text: str, is_observation: str, mode: str = "randomize", done: DataFrame | None = None) -> DataFrame:
    """One record for each request with an observation: its newest one's features, the
    availability gate and stratum, and whether the mode randomises it.

    A request whose task ``known`` (key) doesn't have is closed out: logged as a failure,
    without features, never randomised.  Keys in ``done`` have had their intervention.
    Forced modes give the assignment and propensity at once.
    """
    forced, propensity = MODES[mode]
    observations = messages.where(F.col(is_observation))
    newest = F.max(order).over(_by(key))
    r = evidence.available(evidence.redundancy(observations, key, order, text)).withColumn("_newest", newest).where(F.col(order) == F.col("_newest"))
    kinds = messages.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, F.when(F.col("_n") <= 2, "internal_setup").otherwise("main_agent_call").alias("call_class"))
    r = r.join(kinds, key).join(known.select(key).distinct().withColumn("task_known", F.lit(True)), key, "left").withColumn("task_known", F.coalesce("task_known", F.lit(False)))
    r = r.join(done.select(key).distinct().withColumn("already_intervened", F.lit(True)), key, "left") if done is not None else r.withColumn("already_intervened", F.lit(False))
    ok = F.col("task_known")
    eligible = ok & F.col("available") & (F.col("stratum") != "NONE") & ~F.coalesce("already_intervened", F.lit(False)) & (F.col("call_class") == "main_agent_call") & F.lit(mode != "log_only")
    shown = lambda c, none: F.when(ok, F.col(c)).otherwise(none)
    return r.select(
        key, order, "call_class", "task_known", shown("chars", 0).cast("long").alias("segment_chars"), shown("eligible", 0).cast("long").alias("eligible_lines"), shown("dup", 0).cast("long").alias("duplicate_lines"),
        shown("dup_frac", 0.0).alias("dup_frac"), (ok & F.col("available")).alias("available"), shown("stratum", "").alias("stratum"), eligible.alias("randomise"),
        F.when(eligible, F.lit(forced)).alias("assignment"), F.when(eligible, F.lit(propensity)).alias("propensity"),
        F.when(~ok, "unknown_task_fingerprint").alias("provider_error"), (~ok).alias("infrastructure_failure"),
    )


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def attach_outcome(events: DataFrame) -> DataFrame:
    """Events with usage columns (null where no good answer came): their effective cost, or
    a failure.  A failed event has no cost, so it can't pass for a cheap one."""
    parts = [F.col(c) for c in ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")]
    failed = F.col("input_tokens").isNull()
    zero = [F.coalesce(p, F.lit(0)) for p in parts]
    return events.withColumns({"effective_cost": F.when(~failed, effective_cost(*zero)), "infrastructure_failure": failed, "provider_error": F.when(failed, "bad_upstream")})


def weighted_action(events: DataFrame, key: str, weights: dict[str, float], seed: int) -> DataFrame:
    """key, action, propensity: drawn from the hash of (key, seed) by the actions' weights."""
    total, below, action, propensity = sum(weights.values()), 0.0, None, None
    u: Column = uniform(F.col(key), F.lit(seed))
    for name, weight in weights.items():
        below += weight / total
        action = F.when(u < below, name) if action is None else action.when(u < below, name)
        propensity = F.when(u < below, weight / total) if propensity is None else propensity.when(u < below, weight / total)
    return events.select(key, action.otherwise(name).alias("action"), propensity.otherwise(weight / total).alias("propensity"))
