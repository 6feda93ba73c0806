"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded labelled sample (histogram splits,
logistic loss), with monotonic constraints on chosen features, and flattened into
numpy node arrays that score a batch of documents level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .docstats import FEATURES
from .textkernel import slices

#: Sign of the effect that more of a feature may have on the score.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "bangs_per_word": -1, "bars_per_word": -1, "closed_by_symbol_share": -1}
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass
class Trees:
    """Nodes of all trees: a leaf points to itself and holds a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_hessian: float = 1.0, monotone: dict[str, int] | None = None) -> Trees:
    """Boost ``trees`` trees.  Without rows, or with one class, only the bias is learned
    (even odds without rows, and the class's own side with one class)."""
    signs = [(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES][: x.shape[1]]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Trees(*(np.zeros(0, t) for t in (int, float, int, int, float)), np.zeros(0, int), depth, float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    nodes: list[list] = []
    margin = np.full(len(y), model.bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(gs / (hs + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f, sign in enumerate(signs):
            if level == depth or not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            vl = np.clip(gl / (hl + ridge), low, high)
            vr = np.clip((gs - gl) / (hs - hl + ridge), low, high)
            gain = vl * gl - vl**2 * (hl + ridge) / 2 + vr * (gs - gl) - vr**2 * (hs - hl + ridge) / 2
            gain -= value * gs - value**2 * (hs + ridge) / 2
            gain[(hl < min_hessian) | (hs - hl < min_hessian) | (sign * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k, vl[k], vr[k])
        _, f, k, vl, vr = best
        if f < 0:
            return me
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[f]]
        goes = binned[rows, f] <= k
        left = grow(rows[goes], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[me][:4] = [f, edges[f][k], left, right]
        return me

    roots = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), y - q, q * (1 - q), 0, -np.inf, np.inf))
        tree = Trees(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array(roots[-1:]), depth, 0.0)
        margin += tree.margin(x)
    return Trees(*(np.array([n[i] for n in nodes]) for i in range(5)), np.array(roots), depth, model.bias)


def train(spark: SparkSession, sf_dir: str, max_rows: int = docstats.MAX_FIT_ROWS) -> Trees:
    return fit(*docstats.fit_features(docstats.labelled(spark, sf_dir, "quality", F.lit(True), max_rows)))


def judge(arr: pa.Array, model: Trees, threshold: float = 0.5) -> dict[str, np.ndarray]:
    """Base counts, base_failed and kept of the texts."""
    base, x = docstats.statistics(arr)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    score = model.probability(x)
    return base | {"base_failed": failed, "kept": ~failed & (score >= threshold), "score": score}


def kept(text: Column, model: Trees, threshold: float = 0.5) -> Column:
    """Boolean column: the text passes base rules and model."""

    @F.arrow_udf("boolean")
    def run(arr: pa.Array) -> pa.Array:
        return _over(arr, lambda part: judge(part, model, threshold)["kept"])

    return run(text.cast("string"))


def _over(arr: pa.Array, f) -> pa.Array:
    """A numpy function of texts over an array, in slices of bounded bytes."""
    batch = pa.RecordBatch.from_arrays([arr], ["text"])
    out = [f(part.column("text")) for part in slices(batch, "text")]
    return pa.array(np.concatenate(out) if out else np.zeros(0, bool))


def annotate(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, kept and score of each row of ``docs``.

    Null and empty texts have no words, so they fail; repeated rows are judged each;
    columns other than doc_id and text are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in judge(part.column("text"), model, threshold).items()})

    kind = "doc_id long, " + ", ".join(f"{c} long" for c in docstats.BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document.

    Null and empty texts have no words, so they fail; without labels the base rules alone
    decide; repeated rows are judged each; an empty table gives no rows.
    """
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark, sf_dir))
