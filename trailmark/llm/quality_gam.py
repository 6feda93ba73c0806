"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in cycles and added into that
feature's lookup table; then the pairs of features that explain most of what is
left get two-dimensional tables, boosted in cycles by quadrant cuts.  A score is the
logistic of the intercept and one table entry for each feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .quality_rules import _over
from .textkernel import slices

FOLDS, HELD_OUT = 3, 1


@dataclass
class Additive:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f])]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cuts(c: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of a tree with few leaves over one feature's bins, by best-first cuts."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            k = np.arange(p[0] + 1, p[1])
            if len(k):
                gain = score(p[0], k) + score(k, p[1]) - score(*p)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], p, int(k[i]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step


def _quadrant(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, step) of the best cut of a pair's grid into four."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    gain = -cg[n, m] ** 2 / (ch[n, m] + ridge)
    for a, b, c, d in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
        gs = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
        hs = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]
        gain = gain + gs**2 / (hs + ridge)
    at, to = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(g)
    for rows in (slice(0, at + 1), slice(at + 1, n)):
        for cols in (slice(0, to + 1), slice(to + 1, m)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[at, to]), step


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 120, rate: float = 0.1, bins: int = 64, leaves: int = 3, pairs: int = 6, pair_bins: int = 12, pair_cycles: int = 40, ridge: float = 1.0) -> Additive:
    """Without rows, or with one class, only the intercept is learned."""
    p = (y.sum() + 1) / (len(y) + 2)
    f = x.shape[1]
    model = Additive([np.zeros(0)] * f, [np.zeros(1) for _ in range(f)], [np.zeros(0)] * f, [], [], float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_cuts(c, bins) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_cuts(c, pair_bins) for c in x.T]
    fine = [np.searchsorted(e, c) for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c) for e, c in zip(model.coarse, x.T, strict=True)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(cycles):
        for k, (b, table) in enumerate(zip(fine, model.tables, strict=True)):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), leaves, ridge)
            model.tables[k] += step
            margin += step[b]
    grids = lambda a, b, v: np.bincount(coarse[a] * (len(model.coarse[b]) + 1) + coarse[b], v, (len(model.coarse[a]) + 1) * (len(model.coarse[b]) + 1)).reshape(len(model.coarse[a]) + 1, -1)
    g, h = slopes()
    found = sorted(((_quadrant(grids(a, b, g), grids(a, b, h), ridge)[0], a, b) for a in range(f) for b in range(a + 1, f)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(a, b) for gain, a, b in found[:pairs] if gain > 1e-9]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrant(grids(a, b, g), grids(a, b, h), ridge)[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    for table, b in zip(model.tables, fine, strict=True):  # centred, as tables of an additive model are
        mean = table[b].mean()
        table -= mean
        model.intercept += mean
    return model


def train(spark: SparkSession, sf_dir: str, max_rows: int = docstats.MAX_FIT_ROWS) -> Additive:
    """Fit on labels outside the held-out fold."""
    return fit(*docstats.fit_features(docstats.labelled(spark, sf_dir, "quality", docstats.crc_mod("doc_id", FOLDS) != HELD_OUT, max_rows)))


def accepted(text: Column, model: Additive, threshold: float = 0.5) -> Column:
    """Boolean column: the classifier's score reaches the threshold."""

    @F.arrow_udf("boolean")
    def run(arr: pa.Array) -> pa.Array:
        return _over(arr, lambda part: model.probability(docstats.statistics(part)[1]) >= threshold)

    return run(text.cast("string"))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score and predicted of each row; null text is empty, repeated rows are
    scored each, other columns are ignored, an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.probability(docstats.statistics(part.column("text"))[1])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document.

    Null and empty texts have the score of no words; a null doc_id is scored, never learned
    from, and its held_out is null; without labels the score is 0.5 everywhere; repeated
    rows are scored each; an empty table gives no rows.
    """
    got = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark, sf_dir))
    return got.select("doc_id", (docstats.crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
