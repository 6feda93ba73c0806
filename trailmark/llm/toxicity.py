"""Toxicity by non-negative positive-unlabelled learning.

Documents labelled toxic are the positives; a sample of the corpus, whatever its
labels, is the unlabelled set.  A linear classifier over hashed words minimises the
non-negative risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with the logistic loss,
where the class prior ``pi`` is the share of toxic documents among the labels used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .textkernel import LOWER, slices, span_hash, spans, prefix_hash, text_bytes

FOLDS, HELD_OUT = 5, 0
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 12_000
BUCKETS = 1 << 20
MAX_FEATURES = 4096
MIN_POSITIVE_DOCS = 5

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_TOKEN[ord("'")] = True


def word_buckets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct lower-cased word without punctuation."""
    data, offsets = text_bytes(arr)
    data = LOWER[data]
    starts, ends = spans(_TOKEN[data], offsets)
    bucket = (span_hash(prefix_hash(data), starts, ends) >> np.uint64(44)).astype(np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    pair = np.unique(doc * BUCKETS + bucket)
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Linear:
    weights: np.ndarray  # one for each bucket, mostly 0
    bias: float

    def margin(self, arr: pa.Array) -> np.ndarray:
        doc, bucket = word_buckets(arr)
        return self.bias + np.bincount(doc, self.weights[bucket], len(arr))

    def probability(self, arr: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(arr), -500, 500)))


def fit(doc: np.ndarray, bucket: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """``positive[d]``: document d is a positive, else unlabelled.

    Without positives or unlabelled documents the score is the prior everywhere.
    """
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    model = Linear(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return model
    # Words that positives hold more or less often than the corpus.
    in_p = np.bincount(bucket[positive[doc]], minlength=BUCKETS)
    in_u = np.bincount(bucket[~positive[doc]], minlength=BUCKETS)
    rate_p, rate_u = in_p / n_p, in_u / n_u
    pooled = (in_p + in_u) / (n_p + n_u)
    z = np.abs(rate_p - rate_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    z[(in_p < MIN_POSITIVE_DOCS) | (z < 4)] = 0
    chosen = np.argsort(-z, kind="stable")[: min(MAX_FEATURES, int((z > 0).sum()))]
    if not len(chosen):
        return model
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[bucket] >= 0
    row, col = doc[keep], column[bucket[keep]]
    share = np.where(positive, prior / n_p, 1 / n_u)
    w, b = np.zeros(len(chosen)), model.bias
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        g = b + np.bincount(row, w[col], len(positive))
        q = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        negative_risk = np.logaddexp(0, g)  # loss of calling a document clean
        corrected = (share * np.where(positive, -1, 1) * negative_risk).sum()
        if corrected >= 0:  # d/dg of pi R_p(+) + R_u(-) - pi R_p(-)
            slope = np.where(positive, share * (q - 1) - share * q, share * q)
        else:  # step back from the negative part alone
            slope = np.where(positive, share * q, -share * q)
        grad = np.append(np.bincount(col, slope[row], len(w)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model.weights[chosen] = w
    model.bias = float(b)
    return model


def _sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(document number, bucket, documents) of a bounded sample, on the driver."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                doc, bucket = word_buckets(part.column("text"))
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "words": words})

    got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<int>").toArrow()
    if not got.num_rows:
        return np.zeros(0, int), np.zeros(0, int), 0
    words = got.sort_by([("doc_id", "ascending")]).combine_chunks().column("words").combine_chunks()
    sizes = np.diff(np.asarray(words.offsets))
    return np.repeat(np.arange(len(words)), sizes), words.flatten().to_numpy().astype(np.int64), len(words)


def train(spark: SparkSession, sf_dir: str, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Linear:
    """Fit on at most ``max_positive`` toxic documents outside the held-out fold and
    ``max_unlabelled`` documents taken without regard to labels."""
    fold = docstats.crc_mod("doc_id", FOLDS) != HELD_OUT
    toxic = docstats.labelled(spark, sf_dir, "toxic", fold & (F.col("label") == 1), max_positive)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold & F.col("toxic").isin(0, 1))
    seen = labels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit(7))
    share = min(1.0, 8 * max_unlabelled / max(docs.count(), 1))  # what is sorted doesn't grow with the corpus
    near = docs.select("doc_id").where(fold & (F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))))
    ids = near.distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    doc_p, bucket_p, n_p = _sample(toxic)
    doc_u, bucket_u, n_u = _sample(docstats.one_text(docs.join(F.broadcast(ids), "doc_id"), "doc_id"))
    prior = (seen["toxic"] or 0) / seen["n"] if seen["n"] else 0.5
    return fit(np.concatenate([doc_p, doc_u + n_p]), np.concatenate([bucket_p, bucket_u]), np.arange(n_p + n_u) < n_p, prior)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id, score and predicted of each row; null text is empty (the score of no
    words), repeated rows are scored each, other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.probability(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document.

    Null and empty texts have the score of no words; a null doc_id is scored, never learned
    from, and its held_out is null; without labels the score is 0.5 everywhere; repeated
    rows are scored each; an empty table gives no rows.
    """
    got = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark, sf_dir))
    return got.select("doc_id", (docstats.crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
