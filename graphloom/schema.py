"""Schemas of the property graph and the vocabulary of its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = """node_id string, label string, name string, qualified string, file_path string, repo_slug string, language string,
visibility string, signature string, docstring string, body string, summary string, concepts array<string>, content_hash string,
start_line int, end_line int, methods array<struct<name:string,signature:string,receiver:string>>, embedding array<float>,
introduced_commit string, introduced_at timestamp, last_modified_commit string, last_modified_at timestamp, removed_commit string"""
#: ``target`` is what the source says, ``to_id`` what it was resolved to, the same where it was not
EDGES = """label string, from_id string, to_id string, target string, resolved boolean, call_site string, call_type string, is_dynamic boolean,
props map<string,string>, introduced_commit string, introduced_at timestamp, removed_commit string, repo_slug string"""
REPOS = "slug string, path string, remote_url string, default_branch string, last_commit string, languages array<string>, last_indexed_at timestamp, created_at timestamp"
COMMITS = "repo_slug string, hash string, message string, author string, ts timestamp, files array<string>, indexed boolean"
DIFFS = "repo_slug string, hash string, path string, old_path string, status string, additions int, deletions int, patch string"
MEMORY = "memory_id string, tier string, session_id string, repo_slug string, content string, concepts array<string>, embedding array<float>, token_count int, created_at timestamp"

SESSIONS = "session_id string, repo_slug string, title string, created_at timestamp, updated_at timestamp"
MESSAGES = "session_id string, message_id string, role string, content string, created_at timestamp"
LOG = "ts timestamp, kind string, op string, repo_slug string, label string, id string, other string"

NODE_LABELS = ("function", "class", "file", "module")
EDGE_LABELS = ("calls", "imports", "defines", "inherits", "uses", "constructs", "tests", "data_flow", "reads", "writes", "route", "control_flow", "data_dep", "implements")
#: metadata keys that hold numbers
NUMERIC_PROPS = ("from_line", "to_line", "def_line", "use_line", "mutation_line", "start_line")
#: allowed values of closed columns
ENUMS = {
    "visibility": ("public", "private", "protected", "internal"),
    "kind": ("class", "struct", "interface", "enum", "type"),
    "tier": ("working", "session", "persistent"),
    "role": ("user", "assistant", "system"),
}


def digits_as_int(value: Column) -> Column:
    """The digits of a text as an int (``12a`` is 12); null without any."""
    return F.regexp_replace(value, "[^0-9]", "").try_cast("int")


def numeric_props(edges: DataFrame) -> DataFrame:
    """``edges`` with a column for each numeric metadata key that ``props`` may hold."""
    return edges.withColumns({k: digits_as_int(F.try_element_at("props", F.lit(k))) for k in NUMERIC_PROPS})


def absent_as_null(df: DataFrame) -> DataFrame:
    """Empty strings become null: the graph knows one kind of absence."""
    return df.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c, kind in df.dtypes if kind == "string"})


def require(df: DataFrame, column: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Fail, when evaluated, on a value of ``column`` outside its closed set; null passes."""
    allowed = allowed or ENUMS[column]
    message = F.concat(F.lit(f"{column} is "), F.col(column))
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col(column)))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a schema: missing ones null, others dropped, kinds cast."""
    from pyspark.sql.types import StructType

    return df.select(*(
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)
    ))
