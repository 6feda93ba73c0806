"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_model, media, near_dedup, packing, quality_gam, quality_rules, sentencepiece_model, sstable, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_model.op1,
    "op2_html_main_text": html_text.op2,
    "op3_sstable_tokens": sstable.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_quality_gam": quality_gam.op6,
    "op7_toxicity_pu": toxicity.op7,
    "op8_mixture_packing": packing.op8,
    "op9_media_columns": media.op9,
    "op10_language_model": language_model.op10,
}

SQL: dict[str, str] = {}
