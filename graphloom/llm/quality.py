"""Quality: a generalised additive model with pairwise interactions.

Boosting cycles over the features; each turn fits a shallow tree to one feature's residuals and adds it to that
feature's lookup table.  Then the pairs whose residuals gain most from a four-part cut are boosted likewise.  A
score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.common import bounded_labelled, fold_is, slices, table
from graphloom.llm.toxicity import quantile_edges

#: labelled rows that the model is fitted on, at most
TRAINING_ROWS = 12_000
ACCEPT_AT = 0.5


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, ridge: float, least: int) -> np.ndarray:
    """Value of each bin under the best tree of at most ``leaves`` leaves on one ordered feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            gc, hc, nc = g[lo:hi].cumsum(), h[lo:hi].cumsum(), n[lo:hi].cumsum()
            gain = gc[:-1] ** 2 / (hc[:-1] + ridge) + (gc[-1] - gc[:-1]) ** 2 / (hc[-1] - hc[:-1] + ridge) - gc[-1] ** 2 / (hc[-1] + ridge)
            gain[(nc[:-1] < least) | (nc[-1] - nc[:-1] < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (k, lo + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        lo, hi = parts[k]
        parts[k : k + 1] = [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quarter_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-way table into four parts."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = lambda c: (c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1, -1] - c[-1:, :-1] - c[:-1, -1:] + c[:-1, :-1])
    gain = sum(a**2 / (b + ridge) for a, b in zip(total(gc), total(hc))) - gc[-1, -1] ** 2 / (hc[-1, -1] + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, cycles: int = 60, rate: float = 0.1, bins: int = 32, pairs: int = 8, pair_bins: int = 8,
            ridge: float = 5.0, least: int = 10) -> AdditiveModel:
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        columns = range(x.shape[1])
        edges, coarse = [quantile_edges(x[:, f], bins) for f in columns], [quantile_edges(x[:, f], pair_bins) for f in columns]
        self = cls(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
        at = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
        wide = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(coarse)]
        raw = np.full(len(y), self.base)

        def residual():
            p = 1 / (1 + np.exp(-raw))
            return y - p, p * (1 - p)

        for _ in range(cycles):
            for f in columns:
                g, h = residual()
                k = len(edges[f]) + 1
                sums = [np.bincount(at[f], weights=v, minlength=k) for v in (g, h, np.ones(len(y)))]
                step = rate * _shallow_tree(*sums, 4, ridge, least)
                self.tables[f] += step
                raw += step[at[f]]

        def two_way(a, b, g, h):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = wide[a] * shape[1] + wide[b]
            return cell, [np.bincount(cell, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h)]

        g, h = residual()
        ranked = sorted(((-_quarter_cut(*two_way(a, b, g, h)[1], ridge)[0], a, b) for a in columns for b in range(a)), key=lambda r: r)
        for gain, a, b in ranked[:pairs]:
            if gain < 0:
                self.pairs[a, b] = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
        for _ in range(cycles // 2):
            for (a, b), grid in self.pairs.items():
                g, h = residual()
                cell, sums = two_way(a, b, g, h)
                step = rate * _quarter_cut(*sums, ridge)[1]
                grid += step
                raw += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables)):
            raw += values[np.searchsorted(edge, x[:, f], side="left")]
        if self.pairs:
            wide = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.coarse)]
            for (a, b), grid in self.pairs.items():
                raw += grid[wide[a], wide[b]]
        return 1 / (1 + np.exp(-raw))


def fit(rows: DataFrame) -> AdditiveModel:
    """Fit on (doc_id, text, label) rows, at most ``TRAINING_ROWS``.  Without rows every score is a half."""
    return AdditiveModel.fit(*features.labelled_matrix(rows, None))


def trained(spark: SparkSession, sf_dir: str) -> AdditiveModel:
    """The model of the quality labels outside the held-out fold (crc32 of the id mod 3 is 1)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(bounded_labelled(docs, labels, "quality", TRAINING_ROWS, ~fold_is(F.col("doc_id"), 3, 1)))


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a null or empty text is scored as an empty one.

    Repeated rows are scored each, equal texts alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        return pd.Series(np.concatenate([np.zeros(0), *(shared.value.score(features.matrix(texts[lo:hi], None)) for lo, hi in slices(texts, 4096))]))

    scored = docs.select("doc_id", fold_is(F.col("doc_id"), 3, 1).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT_AT).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
