"""Statistics of whole texts, and bounded labelled samples to fit models on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import NOT_CONTINUATION, WS, Words, per_text, slices, span_hash, spans

#: Most labelled rows that a model is fitted on.
MAX_FIT_ROWS = 20_000
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share",
    "digit_share", "punctuation_share", "distinct_word_share", "words_per_line", "stops_per_word",
    "closed_by_symbol_share", "bangs_per_word", "bars_per_word", "space_share", "high_byte_share",
    "one_byte_word_share", "letter_share",
)


def _repeated(key: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if not len(key):
        return np.zeros(0, bool)
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def _of_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def statistics(arr: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base counts, feature matrix) of the texts; null is empty.

    n_dup_lines: lines with a word that equal an earlier line of the text;
    n_repeat_words: words inside a five-word window that the text holds twice or more.
    """
    w = Words(arr)
    data, n, docs = w.data, w.counts, len(w.counts)
    count = lambda lut: per_text(lut[data], w.offsets)
    is_word = np.zeros(len(data) + 1, np.int32)
    np.cumsum(NOT_CONTINUATION[data] & ~WS[data], out=is_word[1:])
    word_chars = (is_word[w.offsets[1:]] - is_word[w.offsets[:-1]]).astype(np.int64)

    at, h = w.windows(WINDOW)
    again = at[_repeated(_of_text(h, w.doc[at]))]
    covered = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(covered, again, 1)
    np.subtract.at(covered, again + WINDOW, 1)
    repeat = per_text(np.cumsum(covered[:-1]) > 0, w.first)

    starts, ends = spans(data != 10, w.offsets)
    line_doc = np.searchsorted(w.offsets, starts, "right") - 1
    with_word = is_word[ends] > is_word[starts]
    starts, ends, line_doc = starts[with_word], ends[with_word], line_doc[with_word]
    key = _of_text(span_hash(w.prefix, starts, ends), line_doc)
    _, once = np.unique(key, return_index=True)
    lines = np.bincount(line_doc, minlength=docs)
    dup_lines = lines - np.bincount(line_doc[once], minlength=docs)

    distinct = np.bincount(w.doc[np.unique(_of_text(w.hash, w.doc), return_index=True)[1]], minlength=docs)
    base = {"n_words": n, "word_chars": word_chars, "n_symbols": count(_SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": repeat}

    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    size = w.ends - w.starts
    words, bytes_ = np.maximum(n, 1), np.maximum(np.diff(w.offsets), 1)
    letters = count(_LETTER)
    features = np.stack(
        [
            np.log1p(n), word_chars / words, base["n_symbols"] / words, dup_lines / np.maximum(lines, 1), repeat / words,
            count(_UPPER) / np.maximum(letters, 1), count(_DIGIT) / bytes_, count(_PUNCT) / bytes_, distinct / words,
            np.log1p(n / np.maximum(lines, 1)), count(_STOP) / words, per_text(_SYMBOL[last] | (last == 33), w.first) / words,
            per_text(data == 33, w.offsets) / words, per_text(data == 124, w.offsets) / words,
            per_text(WS[data], w.offsets) / bytes_, per_text(data > 127, w.offsets) / bytes_,
            per_text(size == 1, w.first) / words, letters / bytes_,
        ],
        axis=1,
    )
    return base, features


def crc_mod(column: str, n: int):
    """crc32 of the identifier's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string")) % n


def one_text(docs: DataFrame, *keys: str) -> DataFrame:
    """The least text of each key, so that repeated identifiers don't make a sample longer."""
    return docs.groupBy(*keys).agg(F.min("text").alias("text"))


def labelled(spark: SparkSession, sf_dir: str, label: str, fold, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``max_rows`` labelled documents that ``fold`` admits.

    The rows with the smallest hash of doc_id are taken, so the sample is the same in
    every run.  It is the only bounded part of fitting; it is small enough to broadcast.
    A doc_id with labels 0 and 1 counts as 1; one with several texts has its least.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    labels = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & fold)
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one_text(docs.join(F.broadcast(sample), "doc_id"), "doc_id", "label")


def fit_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, on the driver, in doc_id order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, x = statistics(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, int)
    got = got.sort_by([("doc_id", "ascending")]).combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return x, got.column("label").to_numpy().astype(int)
