"""Corpus pipeline: quality classifier, quality rules, near-dedup, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences with their token
ids.  Models are fitted on the labelled documents of ``sf_dir``, not on what a stage
before kept.

In all stages a null text is empty, repeated rows are judged each (near-dedup keeps one
of them), columns of any name pass through, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import near_dedup, packing, quality_gam, quality_rules, storage

#: SQL can express neither the models nor the sampled sketches.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts: a score of 0.5 or more.  Empty texts have
    the score of no words; without labels the score is 0.5, so all stay."""
    return docs.where(quality_gam.accepted(F.col("text"), quality_gam.train(spark, sf_dir)))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees.  Empty texts have no words,
    so they go; without labels the base rules alone decide."""
    return docs.where(quality_rules.kept(F.col("text"), quality_rules.train(spark, sf_dir)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: of ties the least doc_id (null first),
    then the least digest of its text."""
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens at the sources' proportions, with the
    ids (little-endian, four bytes each) that a trainer reads.  Empty texts have the end
    token alone; a null source is a source of its own."""
    return packing.pack(docs).drop("source")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
