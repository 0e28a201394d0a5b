"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's score is the sum of its scores in ``LISTS`` groups of dimensions, one local score list each.
Phase 1 gathers, for every query, the entries at the head of each list; the k-th best whole score among these
vectors is a safe cutoff: the answer holds nothing below it.  The cutoffs are sent out.  Phase 2 collects from each
list the entries of at least cutoff / ``LISTS``; a vector in none of them scores below the cutoff.  Parts too short
to reach that threshold, by the product of lengths, are passed over unscored.  Phase 3 works out, for the collected
entries alone, what the lists that did not give them add, and keeps what reaches the cutoff.  All scores are whole
numbers.  Equal vectors are scored once: of each only the rows that a top k can hold are kept beforehand.  Queries
go round in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, new_folder, release, table

LISTS = 2
#: queries in a block; a block of 64 dimensions is 1 MB
BLOCK = 2048
ROWS_AT_ONCE = 1024


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x).  Rows with a null id, vector or component, or one that is not
    finite, are left out; an empty vector stays and scores 0.  A component with no place in 64 bits is an error."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    most = float(1 << 63)

    def floored(x: Column) -> Column:
        # floor() of a double beyond 64 bits would be the largest long
        return F.when((x * scale >= most) | (x * scale < -most), F.raise_error(F.lit("a component has no place in 64 bits")).cast("long")).otherwise(F.floor(x * scale))

    return vectors.select("vec_id", "embedding").where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, floored).alias("v"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector once, with the ids that a top ``k`` can hold whatever the query's own id is: the
    ``k`` first rows of each of the ``k + 1`` smallest ids.  Ranks are cut to those before they are shuffled."""
    near = rows.withColumn("__id", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("__id") <= k + 1)
    near = near.withColumn("__row", F.row_number().over(W.partitionBy("v", "vec_id").orderBy(F.lit(0)))).where(F.col("__row") <= k)
    return near.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros, longer ones are cut where the other side has nothing."""
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        n = min(width, len(row))
        out[k, :n] = row[:n]
    return out


def _most(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every sum stays below 2**53, in 64 bits below 2**63, else in
    whole numbers of any size, which fail if a score has no place in 64 bits."""
    most = _most(a) * _most(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.array(a.astype(object) @ b.astype(object).T, dtype=object).astype(np.int64)


def _pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``."""
    out = np.empty(len(i), np.int64)
    whole = _most(a) * _most(b) * max(1, a.shape[1]) >= 1 << 63
    for at in range(0, len(i), 1 << 16):
        x, y = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        out[at : at + (1 << 16)] = (x.astype(object) * y.astype(object)).sum(1).astype(np.int64) if whole else np.einsum("ij,ij->i", x, y)
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of 64-bit numbers; an error where one has no place in 64 bits."""
    out = a + b
    if len(out) and (((a ^ out) & (b ^ out)) < 0).any():
        raise OverflowError("a score has no place in 64 bits")
    return out


def _lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(1))


class _Best:
    """The ``k`` best (score, id) of each query met so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.held = k, [np.zeros((0, 2), np.int64) for _ in range(queries)]

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(i, kind="stable")
        i, score, ids = i[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, np.diff(i) > 0]) if len(i) else np.zeros(0, np.int64)
        for a, b in zip(first, np.r_[first[1:], len(i)]):
            met = np.concatenate([self.held[i[a]], np.stack([score[a:b], ids[a:b]], 1)])
            self.held[i[a]] = met[np.lexsort((met[:, 1], -met[:, 0]))[: self.k]]


def _expanded(ids: list, own: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a class as pairs of a query and the class's ids, without the query's own."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
    first, n = np.cumsum(sizes) - sizes, sizes[j]
    at = np.repeat(first[j], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, score, found = np.repeat(i, n), np.repeat(score, n), flat[at]
    other = found != own[i]
    return i[other], score[other], found[other]


def _blocks(pdf: pd.DataFrame, width: int) -> Iterator[tuple[list, np.ndarray]]:
    for at in range(0, len(pdf), ROWS_AT_ONCE):
        part = pdf.iloc[at : at + ROWS_AT_ONCE]
        yield part["ids"].tolist(), _matrix(part["v"].tolist(), width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` highest inner products over all other rows.

    A query is a distinct id for which ``is_query`` (a condition on vec_id) holds; if it has several rows, that
    with the least vector counts.  Candidates are all rows of another id, repeats included; ties go to the
    smaller vec_id.  Fewer candidates than ``k`` give fewer rows; no usable vector gives none.  Scores are 64-bit
    whole numbers; one that has no place in them is an error, never a wrong number.
    """
    spark = vectors.sparkSession
    usable = integer_vectors(vectors, scale)
    queries = materialise(usable.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    total, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialise(classes_of(usable, k))
    rounds = -(-total // block)
    edges = np.linspace(0, width, LISTS + 1).astype(int)
    spans = list(zip(edges, edges[1:]))
    folder = new_folder(spark)
    for turn in range(rounds):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == turn).orderBy("vec_id").collect()  # about ``block`` vectors
        ids, q = np.array([r.vec_id for r in mine], np.int64), _matrix([r.v for r in mine], width)
        asked = spark.sparkContext.broadcast((ids, q))

        def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Phase 1: whole scores of the entries at the head of each local list."""
            ids, q = asked.value
            best = _Best(len(ids), k)
            for pdf in batches:
                for members, c in _blocks(pdf, width):
                    n = min(k + 1, len(members))
                    i, j = [], []
                    for lo, hi in spans:
                        local = _exact(q[:, lo:hi], c[:, lo:hi])
                        j.append(np.argpartition(local, len(members) - n, axis=1)[:, len(members) - n :].ravel())
                        i.append(np.repeat(np.arange(len(ids)), n))
                    code = np.unique(np.concatenate(i) * len(members) + np.concatenate(j))
                    i, j = code // len(members), code % len(members)
                    best.add(*_expanded(members, ids, i, j, _pairs(q, i, c, j)))
            out = [(int(a), int(s)) for a, b in zip(ids, best.held) for s in b[:, 0]]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "score"])

        # of each query the k-th best: an array of at most ``block`` cutoffs comes back
        ranked = rows.mapInPandas(heads, "query_id long, score long").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"))))
        cut = {r.query_id: r.score for r in ranked.where(F.col("n") <= k).where(F.col("n") == k).collect()}
        lowest = np.iinfo(np.int64).min // 4
        sent = spark.sparkContext.broadcast(np.array([cut.get(i, lowest) for i in ids.tolist()], np.int64))

        def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Phases 2 and 3: entries over the uniform threshold, worked out; the k best for each query and task."""
            ids, q = asked.value
            cutoff = sent.value
            least = -(-cutoff // LISTS)  # whole scores: some list has that much or more
            reach = [_lengths(q[:, lo:hi]) for lo, hi in spans]
            best = _Best(len(ids), k)
            for pdf in batches:
                for members, c in _blocks(pdf, width):
                    size, given = len(members), []
                    for (lo, hi), mine in zip(spans, reach):
                        # a part whose length cannot make up the threshold of any query is not scored
                        far = _lengths(c[:, lo:hi])
                        open_ = np.flatnonzero(far * mine.max(initial=0) * (1 + 1e-9) + 1 >= least.min())
                        local = _exact(q[:, lo:hi], c[open_, lo:hi])
                        i, j = np.nonzero(local >= least[:, None])
                        given.append((i * size + open_[j], local[i, j]))
                    code = np.unique(np.concatenate([x for x, _ in given]))
                    i, j, score = code // size, code % size, np.zeros(len(code), np.int64)
                    for (lo, hi), (have, local) in zip(spans, given):
                        known = np.searchsorted(code, have)
                        score[known] = _added(score[known], local)
                        missing = np.ones(len(code), bool)
                        missing[known] = False
                        score[missing] = _added(score[missing], _pairs(q[:, lo:hi], i[missing], c[:, lo:hi], j[missing]))
                    stay = score >= cutoff[i]
                    best.add(*_expanded(members, ids, i[stay], j[stay], score[stay]))
            out = [(int(a), int(v), int(s)) for a, b in zip(ids, best.held) for s, v in b]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        kept = rows.mapInPandas(collect, "query_id long, vec_id long, score long")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
    release(queries, rows)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
