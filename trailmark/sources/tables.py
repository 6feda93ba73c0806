"""Canonical tables over the star-schema test data.

The operators work on canonical long tables (events, messages, ledger, grades, votes,
trial rows).  These adapters derive them from the generated tables; real traces come
through ``ingest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import content_hash, effective_cost

EVENT_TYPES = {"error": "TOOL_ERROR", "view": "READ", "click": "SEARCH", "purchase": "EDIT", "signup": "TEST"}
BASELINE = "N"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, event_index, etype, args_hash, output_hash, target, value: one row an event."""
    e = read(spark, sf_dir, "events")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.create_map(*(F.lit(x) for p in EVENT_TYPES.items() for x in p))[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("trace_id"), index.alias("event_index"), F.coalesce(kind, F.lit("OTHER")).alias("etype"),
        content_hash(F.concat_ws("|", "event_type", "props")).alias("args_hash"), content_hash(F.col("props")).alias("output_hash"),
        F.col("props").alias("target"), "value",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, idx, role, text, is_obs: conversations, whose assistant turns are observations."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("req_id"), F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("text"), ((F.col("role") == "assistant") & (F.col("turn") > 1)).alias("is_obs"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, idx, role, text, is_obs: each document a message of a request of 32."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 32).cast("long").alias("req_id"), (F.col("doc_id") % 32).alias("idx"), F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 32 > 1).alias("is_obs"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, method, call_index and token counts of each call."""
    c = F.col
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("task_id"), c("l_returnflag").alias("method"), F.row_number().over(order).alias("call_index"), c("l_quantity").alias("input_tokens"),
        c("l_extendedprice").alias("cache_read_tokens"), (c("l_tax") * 1000).alias("cache_creation_tokens"), (c("l_discount") * 100).alias("output_tokens"),
        (c("l_linestatus") == "F").alias("changed"), c("l_partkey").alias("chars_removed"), c("l_suppkey").alias("repo_id"),
    )


def with_cost(calls: DataFrame) -> DataFrame:
    return calls.withColumn("cost", effective_cost(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("output_tokens")))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, cluster, baseline and candidate outcomes."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("task_id"), F.col("source").alias("cluster"), "lang", (F.col("quality") == 1).alias("baseline"), (F.col("toxic") == 0).alias("candidate"), F.col("n_chars").cast("double").alias("y"))


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, cluster, stratum, a (arm), y, moderator: one row a randomised unit."""
    g = grades(spark, sf_dir)
    return g.select(F.col("task_id").alias("unit"), "cluster", F.when(F.col("baseline"), "HIGH").otherwise("MIXED").alias("stratum"), (~F.col("candidate")).cast("int").alias("a"), "y", (F.col("task_id") % 97 / 97.0).alias("moderator"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, rater, label, labels: three raters derived from hashes of the document."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "lang")
    raters = d.select("unit", "lang", F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3"))).alias("rater"))
    digit = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("unit").cast("string"), "rater"), 256), 1, 1), 16, 10).cast("int")
    label = F.when(digit < 10, F.col("lang")).when(digit < 13, "en").when(digit < 15, "xx")
    many = F.array_compact(F.array(F.when(digit % 2 == 0, "A"), F.when(digit % 3 == 0, "B"), F.when(digit > 7, "C"), F.when(digit % 5 == 1, "D")))
    return raters.select("unit", "rater", label.alias("label"), many.alias("labels"), digit.alias("digit"))
