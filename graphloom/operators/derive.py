"""Computed columns of nodes: degrees, centrality and counts over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_stale(last_indexed_at: Column, as_of: Column, hours: int = 24) -> Column:
    """Not indexed, or longer ago than ``hours``."""
    return last_indexed_at.isNull() | (last_indexed_at < as_of - F.make_dt_interval(hours=F.lit(hours)))


def degrees(nodes: DataFrame, edges: DataFrame, label: str = "calls", node_label: str = "function") -> DataFrame:
    """node_id, call_count, callee_count, centrality, is_leaf and is_entry_point of the nodes of one label.

    Multi-edges count each.  One pass over the edges: both ends of an edge are summed in the same aggregation.
    """
    ends = edges.where(F.col("label") == label).select(
        F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                          F.struct(F.col("to_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")
    ).groupBy("e.node_id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    count_in, count_out = F.coalesce("i", F.lit(0)).cast("long"), F.coalesce("o", F.lit(0)).cast("long")
    return nodes.where(F.col("label") == node_label).select("node_id").join(ends, "node_id", "left").select(
        "node_id", count_in.alias("call_count"), count_out.alias("callee_count"), (count_in + count_out).alias("centrality"),
        (count_out == 0).alias("is_leaf"), ((count_in == 0) & (count_out > 0)).alias("is_entry_point"),
    )


def edge_count(nodes: DataFrame, edges: DataFrame, label: str, node_label: str, other_labels: list[str], outgoing: bool, name: str) -> DataFrame:
    """node_id and ``name``: how many edges of ``label`` join a node to nodes of ``other_labels``."""
    here, there = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    others = nodes.where(F.col("label").isin(*other_labels)).select(F.col("node_id").alias(there))
    counts = edges.where(F.col("label") == label).join(others, there, "left_semi").groupBy(F.col(here).alias("node_id")).agg(F.count("*").alias(name))
    return nodes.where(F.col("label") == node_label).select("node_id").join(counts, "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def symbol_count(nodes: DataFrame, edges: DataFrame, node_label: str = "file", symbols: tuple[str, ...] = ("function", "class")) -> DataFrame:
    return edge_count(nodes, edges, "defines", node_label, list(symbols), True, "symbol_count")


def method_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edge_count(nodes, edges, "defines", "class", ["function"], True, "method_count")


def class_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many classes a class inherits from."""
    return edge_count(nodes, edges, "inherits", "class", ["class"], True, "depth")


def file_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many files import a module."""
    return edge_count(nodes, edges, "imports", "module", ["file"], False, "file_count")


def file_paths(nodes: DataFrame, labels: tuple[str, ...] = ("function", "class", "file")) -> DataFrame:
    """Distinct non-empty file paths of nodes of these labels."""
    return nodes.where(F.col("label").isin(*labels) & (F.col("file_path") != "")).select("file_path").distinct()


def coverage(counts: DataFrame) -> DataFrame:
    """Percentages of (files, parsed, nodes, embedded, summarised, edges, resolved): four guarded ratios."""
    ratio = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(
        ratio("parsed", "files").alias("parse_pct"), ratio("embedded", "nodes").alias("embed_pct"),
        ratio("summarised", "nodes").alias("summary_pct"), ratio("resolved", "edges").alias("resolve_pct"),
    )
