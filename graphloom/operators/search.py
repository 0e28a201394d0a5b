"""Search and ranking: vector top-k, BM25, rank fusion, graph expansion, concept rerank and the hybrid query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.storage import cut

RRF_K = 60
K1, B = 1.2, 0.75
DIGITS = 6  # scores are rounded before they are ranked, so that sums in another order rank alike


def _literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_scores(nodes: DataFrame, query: list[float], id_column: str = "node_id", column: str = "embedding") -> DataFrame:
    """(id, score): cosine similarity to the query; rows without a vector of that length are left out."""
    score = F.round(vectors.cosine(F.col(column), _literal(query)), DIGITS)
    return nodes.select(F.col(id_column), score.alias("score")).where("score is not null")


def vector_search(nodes: DataFrame, query: list[float], k: int = 10, min_score: float | None = None, labels: list[str] | None = None, id_column: str = "node_id", column: str = "embedding") -> DataFrame:
    """The ``k`` most similar nodes, best first, ties by id; a score equal to ``min_score`` is kept.  An exact scan."""
    if labels:
        nodes = nodes.where(F.col("label").isin(*labels))
    found = vector_scores(nodes, query, id_column, column)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return found.orderBy(F.desc("score"), id_column).limit(k)


def best_by_node(hits: DataFrame) -> DataFrame:
    """One row for each node, with its highest score."""
    return hits.groupBy("node_id").agg(F.max("score").alias("score"))


def similar_to(nodes: DataFrame, node_id, query: list[float], k: int = 10, other_than: tuple[str, object] | None = None, id_column: str = "node_id") -> DataFrame:
    """Nodes like one node, whose vector is ``query``: ``k`` (at most 50) + 1 are fetched and the node itself is dropped.

    ``other_than`` (a column and the node's own value) also drops its like, after the cut: fewer may remain.
    """
    k = max(1, min(k or 10, 50))
    columns = [c for c in ((other_than[0],) if other_than else ()) if c not in (id_column,)]
    scored = nodes.select(id_column, *columns, F.round(vectors.cosine(F.col("embedding"), _literal(query)), DIGITS).alias("score")).where("score is not null")
    top = scored.orderBy(F.desc("score"), id_column).limit(k + 1).where(F.col(id_column) != node_id).orderBy(F.desc("score"), id_column).limit(k)
    return top.where(F.col(other_than[0]) != other_than[1]).drop(*columns) if other_than else top


# --- BM25 ---------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, id_column: str, fields: dict[str, Column]) -> DataFrame:
    """Inverted index (id, field, term, tf, length, head) of token columns; ``head`` holds for one posting of a document's field.

    Tokens are made once and counted inside each row, as runs of equal ones in their order: nothing is moved.
    """
    parts = None
    for field, tokens in fields.items():
        part = docs.select(F.col(id_column), F.lit(field).alias("field"), F.sort_array(tokens).alias("t"))
        runs = F.array_compact(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i)))
        part = part.select(id_column, "field", "t", F.size("t").alias("length"), runs.alias("at"))
        one = lambda i, j: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", j + 1), "length") - i).cast("long").alias("tf"), (j == 0).alias("head"))
        part = part.select(id_column, "field", "length", F.explode(F.transform("at", one)).alias("p")).select(id_column, "field", "p.term", "p.tf", "length", "p.head")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def bm25_scores(docs: DataFrame, id_column: str, fields: dict[str, Column], terms: list[str]) -> DataFrame:
    """(id, score): BM25 of each field against the terms, summed over fields; a document needs one term.

    Term counts are taken inside each row: only the query's terms are exploded, never all tokens.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select(F.col(id_column), F.lit(0.0).alias("score")).where("false")
    counted, totals = None, None
    for field, tokens in fields.items():
        part = docs.select(F.col(id_column), F.lit(field).alias("field"), tokens.alias("t")).where(F.size("t") > 0)
        part = part.select(id_column, "field", F.size("t").alias("length"), F.filter("t", lambda x: x.isin(*terms)).alias("t"))
        counted = part if counted is None else counted.unionByName(part)
    totals = counted.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = counted.where(F.size("t") > 0).select(id_column, "field", "length", F.explode("t").alias("term")).groupBy(id_column, "field", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # at most terms x fields rows
    joined = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(totals), "field")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy(id_column).agg(F.round(F.sum(part), DIGITS).alias("score"))


def text_search(docs: DataFrame, query: str, k: int = 10, id_column: str = "node_id", fields: dict[str, Column] | None = None) -> DataFrame:
    """The ``k`` best documents for a query, best first, ties by id."""
    fields = fields or {"name": text.code_tokens(F.coalesce("name", F.lit(""))), "qualified": text.code_tokens(F.coalesce("qualified", F.lit(""))), "docstring": text.stems(text.word_tokens(F.coalesce("docstring", F.lit(""))))}
    # prose is stemmed, names are not: each term is looked for as it stands and by its stem
    terms = query_terms(query)
    return bm25_scores(docs, id_column, fields, [*terms, *(text.stem(t) for t in terms)]).orderBy(F.desc("score"), id_column).limit(k)


def query_terms(query: str) -> list[str]:
    """Terms of a query by the rules of ``code_tokens``."""
    import re

    apart = re.sub("([a-z0-9])([A-Z])", r"\1 \2", query).lower()
    folded = apart.translate(str.maketrans(text.ACCENTS, text.FOLDED)).replace("ß", "ss")
    return [t for t in re.split("[^a-z0-9]+", folded) if t]


# --- fusion, expansion, rerank ------------------------------------------------------------------------------------


def boost(centrality: Column) -> Column:
    """ln(1 + centrality) between 1 and 2."""
    return F.least(F.greatest(F.log1p(centrality), F.lit(1.0)), F.lit(2.0))


def ranked(hits: DataFrame, id_column: str = "node_id") -> DataFrame:
    """Hits (id, score) of one short, limited list with their 1-based ``rank``, ties by id."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_column)))


def fuse(arms: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K, id_column: str = "node_id", centrality: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): (id, score), best first, ties by id.

    A negative ``k`` is the default.  ``centrality`` (id, centrality) multiplies scores by its boost.
    """
    k = RRF_K if k < 0 else k
    weights = weights or [1.0] * len(arms)
    every = None
    for arm, w in zip(arms, weights):
        part = arm.select(id_column, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy(id_column).agg(F.sum("s").alias("s"))
    if centrality is not None:
        summed = summed.join(centrality.select(id_column, "centrality"), id_column, "left").withColumn("s", F.col("s") * boost(F.coalesce("centrality", F.lit(0))))
    return summed.select(id_column, F.round("s", DIGITS).alias("score")).orderBy(F.desc("score"), id_column)


def expand(hits: DataFrame, edges: DataFrame, top: int = 5, share: float = 0.6, label: str = "calls") -> DataFrame:
    """Hits (node_id, score) and the callers and callees of the best ``top``, which score ``share`` of their parent.

    A node reached from several parents takes the best placed one, from callers before callees; known hits keep
    their score.  (node_id, score, expanded), best first.
    """
    best = hits.orderBy(F.desc("score"), "node_id").limit(top)
    best = best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "node_id")))
    calls = edges.where(F.col("label") == label)
    parents = F.broadcast(best.select(F.col("node_id").alias("parent"), "place", F.col("score").alias("parent_score")))
    callers = calls.join(parents, F.col("to_id") == F.col("parent")).select(F.col("from_id").alias("node_id"), "place", F.lit(0).alias("side"), "parent_score")
    callees = calls.join(parents, F.col("from_id") == F.col("parent")).select(F.col("to_id").alias("node_id"), "place", F.lit(1).alias("side"), "parent_score")
    reached = callers.unionByName(callees).groupBy("node_id").agg(F.min_by("parent_score", F.struct("place", "side")).alias("parent_score"))
    new = reached.join(hits.select("node_id"), "node_id", "left_anti").select("node_id", F.round(F.col("parent_score") * share, DIGITS).alias("score"), F.lit(True).alias("expanded"))
    return hits.select("node_id", "score", F.lit(False).alias("expanded")).unionByName(new).orderBy(F.desc("score"), "node_id")


def concept_rerank(hits: DataFrame, query: str, concepts: Column = None, centrality: Column = None) -> DataFrame:
    """Hits (node_id, score, concepts, centrality) with scores doubled where a part of a concept (split at ``-``) is a
    query term of over two bytes, and raised by up to 1.3 with centrality.  Best first, ties by id."""
    terms = [t for t in query.lower().split() if len(t.encode()) > 2]
    concepts = F.col("concepts") if concepts is None else concepts
    centrality = F.coalesce("centrality", F.lit(0)) if centrality is None else centrality
    parts = F.flatten(F.transform(concepts, lambda c: F.split(F.lower(c), "-")))
    match = F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, terms))), F.lit(False)) if terms else F.lit(False)
    lift = F.when(centrality > 0, F.least(1 + 0.1 * F.log1p(centrality), F.lit(1.3))).otherwise(1.0)
    score = F.round(F.col("score") * F.when(match, 2.0).otherwise(1.0) * lift, DIGITS)
    return hits.withColumn("score", score).orderBy(F.desc("score"), "node_id")


DEFAULT_TOP_K, DEFAULT_MIN_SCORE = 10, 0.5
SEARCH_LABELS = ("function", "class", "file")


def hybrid_stages(nodes: DataFrame, edges: DataFrame, centrality: DataFrame, query: str, query_vector: list[float], top_k: int = 0, min_score: float = 0.0,
                  file_prefix: str | None = None, labels: tuple[str, ...] | None = SEARCH_LABELS, fields: dict[str, Column] | None = None) -> Iterator[tuple[str, DataFrame]]:
    """The hybrid query, stage by stage: vector_hit, fts_hit, fused, expanded, reranked, done.

    Zero means the default.  Each arm fetches twice ``top_k``; the path prefix is applied after the rerank and
    before the last cut.  A stage runs when its frame is used or, from ``fused`` on, when it is reached: the few fused
    rows are written down, as the later stages read them several times.
    """
    top_k, min_score = top_k or DEFAULT_TOP_K, min_score or DEFAULT_MIN_SCORE
    if labels:
        nodes = nodes.where(F.col("label").isin(*labels))
    by_vector = vector_search(nodes, query_vector, 2 * top_k, min_score)
    yield "vector_hit", by_vector
    by_text = text_search(nodes, query, 2 * top_k, fields=fields)
    yield "fts_hit", by_text
    fused = cut(fuse([ranked(by_vector), ranked(by_text)], centrality=centrality))
    yield "fused", fused
    grown = expand(fused, edges)
    yield "expanded", grown
    about = nodes.select("node_id", "concepts", "file_path")
    scored = grown.join(about, "node_id", "left").join(centrality.select("node_id", "centrality"), "node_id", "left")
    scored = scored.withColumn("centrality", F.when(F.col("expanded"), 0).otherwise(F.col("centrality")))
    reranked = concept_rerank(scored, query)
    yield "reranked", reranked
    if file_prefix:
        reranked = reranked.where(F.col("file_path").startswith(file_prefix))
    yield "done", reranked.orderBy(F.desc("score"), "node_id").limit(top_k).select("node_id", "score", "expanded")


def hybrid_query(*args, **kwargs) -> DataFrame:
    """The last stage of ``hybrid_stages``: at most top_k rows (node_id, score, expanded)."""
    for _, frame in hybrid_stages(*args, **kwargs):
        pass
    return frame


# --- texts for embedding ------------------------------------------------------------------------------------------

#: fixed values: characters for each section; the body takes what is left
SECTIONS = {"prefix": 200, "summary": 500, "concepts": 100, "signature": 300, "neighbours": 800}


def embed_budget(context_tokens: int) -> dict[str, int]:
    total = context_tokens * 3 if context_tokens > 0 else 6000
    return {**SECTIONS, "body": total - sum(SECTIONS.values()), "total": total}


def context_text(budget: dict[str, int], label: Column, qualified: Column, summary: Column, docstring: Column, concepts: Column, signature: Column, body: Column,
                 neighbours: Column | None = None, prefix: str = "") -> Column:
    """The text that stands for a node: prefix, summary or docstring, concepts, signature, neighbours, body, each cut to
    its budget in characters and the whole to the total."""
    have = lambda c: F.when(F.length(c) > 0, c)
    head = F.substring(F.concat(F.lit(prefix + "["), F.upper(label), F.lit("] "), F.coalesce(qualified, F.lit(""))), 1, budget["prefix"])
    about = F.concat(F.lit(" — "), F.substring(F.coalesce(have(summary), have(docstring)), 1, budget["summary"]))
    named = F.when(F.size(concepts) > 0, F.concat(F.lit(" Concepts: "), F.substring(F.array_join(concepts, ", "), 1, budget["concepts"]), F.lit(".")))
    shape = F.concat(F.lit("Signature: "), F.substring(have(signature), 1, budget["signature"]), F.lit("\n"))
    near = F.substring(F.coalesce(neighbours, F.lit("")), 1, budget["neighbours"]) if neighbours is not None else F.lit("")
    code = F.concat(F.lit("---\n"), F.substring(have(body), 1, budget["body"]))
    whole = F.concat(head, *(F.coalesce(x, F.lit("")) for x in (about, named)), F.lit("\n"), F.coalesce(shape, F.lit("")), near, F.coalesce(code, F.lit("")))
    return F.substring(whole, 1, budget["total"])


def embed_missing(nodes: DataFrame, content: Column, embed_fn: Callable[[list[str]], list[list[float]]], batch: int = 100, force: bool = False) -> DataFrame:
    """(node_id, embedding) for nodes without a vector (all with ``force``): each distinct text is embedded once, in
    batches, and given to every node that has it."""
    todo = nodes if force else nodes.where("embedding is null")
    texts = todo.select("node_id", content.alias("text")).withColumn("hash", F.sha2("text", 256))
    distinct = texts.select("hash", "text").dropDuplicates(["hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"hash": part["hash"].astype(object), "embedding": embed_fn(part["text"].tolist())})

    done = distinct.mapInPandas(run, "hash string, embedding array<float>")
    return texts.select("node_id", "hash").join(done, "hash").select("node_id", "embedding")


def summarise_missing(nodes: DataFrame, summarise_fn: Callable[[list[str]], list[tuple[str, list[str]]]], batch: int = 20, force: bool = False) -> DataFrame:
    """(node_id, summary, concepts) for the nodes that need a summary (all functions and classes with a body, with
    ``force``): each distinct body is described once, in batches, and what was said is given to every node that has it."""
    need = needs_summary(F.col("label"), F.col("summary"), F.col("docstring"), F.col("body"), F.col("name"), F.col("start_line"), F.col("end_line"))
    todo = nodes.where(F.col("label").isin("function", "class") & (F.coalesce(F.trim("body"), F.lit("")) != "") if force else need)
    texts = todo.select("node_id", F.col("body").alias("text"), F.sha2("body", 256).alias("hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                said = summarise_fn(part["text"].tolist())
                yield pd.DataFrame({"hash": part["hash"].astype(object).to_numpy(), "summary": [x for x, _ in said], "concepts": [list(c) for _, c in said]})

    done = texts.select("hash", "text").dropDuplicates(["hash"]).mapInPandas(run, "hash string, summary string, concepts array<string>")
    return texts.select("node_id", "hash").join(done, "hash").select("node_id", "summary", "concepts")


def to_reembed(stored_nodes: DataFrame, stored_edges: DataFrame) -> DataFrame:
    """Ids whose text may have changed: stored nodes and both ends of stored edges."""
    return stored_nodes.select("node_id").union(stored_edges.select("from_id")).union(stored_edges.select("to_id")).distinct()


def needs_summary(label: Column, summary: Column, docstring: Column, body: Column, name: Column, start: Column, end: Column) -> Column:
    """Functions and classes of 50 lines or more with a body, no summary or docstring, that are no tests."""
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return label.isin("function", "class") & none(summary) & none(docstring) & ~none(body) & ~(name.startswith("Test") | name.startswith("Benchmark")) & (end - start >= 50)


def idf(n: int, df: int) -> float:
    return math.log1p((n - df + 0.5) / (df + 0.5))


# --- approximate search -------------------------------------------------------------------------------------------


def bucket_index(nodes: DataFrame, dim: int, id_column: str = "node_id", column: str = "embedding", tables: int = 8, bucket: float = 1.5, seed: int = 7) -> DataFrame:
    """(id, embedding, b0, b1, ...): vectors of ``dim`` components with the number of their slab, of width ``bucket``, across
    each of ``tables`` random directions.  Stored, it is the index that ``approximate_search`` reads."""
    rows = nodes.where((F.size(column) == dim) & (vectors.norm(F.col(column)) > 0))
    return rows.select(id_column, F.col(column).alias("embedding"), *(b.cast("int").alias(f"b{k}") for k, b in enumerate(bucket_columns(F.col(column), dim, tables, bucket, seed))))


def approximate_search(index: DataFrame, query: list[float], k: int = 10, id_column: str = "node_id", tables: int = 8, bucket: float = 1.5, least: int = 3, seed: int = 7) -> DataFrame:
    """Up to ``k`` nodes like ``vector_search`` gives, from a ``bucket_index`` made with the same parameters.

    Only rows that share ``least`` slabs or more with the query are scored, so a few of the best may be missing: the
    numbers are compared at the scan, where a row's vector is read only if they agree.  The exact scan is the contract.
    """
    mine = bucket_numbers(query, tables, bucket, seed)
    shared = sum((F.col(f"b{t}") == F.lit(m)).cast("int") for t, m in enumerate(mine))
    return vector_scores(index.where(shared >= least), query, id_column).orderBy(F.desc("score"), id_column).limit(k)


def _directions(dim: int, tables: int, seed: int) -> list[list[float]]:
    import random

    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(tables)]


def bucket_columns(v: Column, dim: int, tables: int, bucket: float, seed: int) -> list[Column]:
    """Bucket numbers of a vector column in each random direction."""
    return [F.floor(vectors.dot(v, _literal(d)) / vectors.norm(v) / bucket) for d in _directions(dim, tables, seed)]


def bucket_numbers(v: list[float], tables: int, bucket: float, seed: int) -> list[int]:
    size = math.sqrt(sum(float(x) ** 2 for x in v)) or 1.0
    return [math.floor(sum(a * float(b) for a, b in zip(d, v)) / size / bucket) for d in _directions(len(v), tables, seed)]
