"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.common import bounded_labelled, fold_is, slices, table, unused

#: labelled rows that the model is fitted on, at most
TRAINING_ROWS = 12_000
REJECT_AT = 0.3


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


@dataclass
class BoostedTrees:
    """Complete trees of one depth; a node sends a row right where its feature is above the threshold."""

    base: float
    rate: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray
    leaf: np.ndarray  # trees x leaves

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 32, ridge: float = 5.0, least: int = 10) -> BoostedTrees:
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        base = float(np.log(prior / (1 - prior)))
        edges = [quantile_edges(x[:, f], bins) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if x.shape[1] else np.zeros((len(y), 0), int)
        raw, inner = np.full(len(y), base), (1 << depth) - 1
        feature, above, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                gain, pick_f, pick_b = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    cell = (node - first) * k + binned[:, f]
                    gs, hs, ns = (np.bincount(cell, weights=v, minlength=width * k).reshape(width, k).cumsum(1) for v in (g, h, np.ones(len(y))))
                    gl, hl, nl, gt, ht, nt = gs[:, :-1], hs[:, :-1], ns[:, :-1], gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    score = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    score[(nl < least) | (nt - nl < least)] = 0
                    b = score.argmax(1)
                    better = score[np.arange(width), b] > gain
                    gain[better], pick_f[better], pick_b[better] = score[np.arange(width), b][better], f, b[better]
                split = pick_b >= 0
                feature[t, first : first + width] = pick_f
                above[t, first : first + width] = [edges[f][b] if s else np.inf for f, b, s in zip(pick_f, pick_b, split)]
                own = node - first
                right = split[own] & (binned[np.arange(len(y)), pick_f[own]] > pick_b[own])
                node = 2 * node + 1 + right
            own = node - inner
            gs, hs = np.bincount(own, weights=g, minlength=inner + 1), np.bincount(own, weights=h, minlength=inner + 1)
            leaf[t] = gs / (hs + ridge)
            raw += rate * leaf[t][own]
        return cls(base, rate, feature, above, leaf)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            out += self.rate * leaf[node - inner]
        return out


@dataclass
class Isotonic:
    """Non-decreasing map of raw scores to probabilities, linear between the pooled blocks."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
        for r, v in zip(raw[order], y[order]):
            blocks.append([v, 1.0, r])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        if not blocks:
            return cls(np.zeros(1), np.full(1, 0.5))
        return cls(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        # a millionth keeps the raw order inside a block; the rest is the calibrated value
        return (1 - 1e-6) * np.interp(raw, self.at, self.value) + 1e-6 / (1 + np.exp(-raw))


@dataclass
class ToxicityModel:
    learned: dict[str, float]
    trees: BoostedTrees
    calibrate: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = [self.trees.raw(features.matrix(texts[lo:hi], self.learned)) for lo, hi in slices(texts, 4096)]
        return np.clip(self.calibrate(np.concatenate([np.zeros(0), *raw])), 0, 1)


def fit(rows: DataFrame) -> ToxicityModel:
    """Fit on (doc_id, text, label) rows, at most ``TRAINING_ROWS``.  Without rows every score is about a half."""
    learned = features.word_odds(rows)
    x, y = features.labelled_matrix(rows, learned)
    part = np.arange(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        if (part != k).any() and (part == k).any():
            held[part == k] = BoostedTrees.fit(x[part != k], y[part != k]).raw(x[part == k])
    return ToxicityModel(learned, BoostedTrees.fit(x, y), Isotonic.fit(held, y))


def score_column(spark: SparkSession, model: ToxicityModel):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()))

    return score


def trained(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """The model of the toxicity labels outside the held-out fold (crc32 of the id mod 4 is 2)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(bounded_labelled(docs, labels, "toxic", TRAINING_ROWS, ~fold_is(F.col("doc_id"), 4, 2)))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a null or empty text is scored as an empty one.

    Repeated rows are scored each, equal texts alike; an empty table gives no rows.
    """
    score = score_column(docs.sparkSession, model)(F.col("text"))
    scored = docs.select("doc_id", fold_is(F.col("doc_id"), 4, 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that score ``REJECT_AT`` or more; all columns stay, whatever their names.

    Repeated rows go or stay together; an empty table stays empty.
    """
    score, name = score_column(docs.sparkSession, model), unused(docs, "__toxicity")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) < REJECT_AT).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
