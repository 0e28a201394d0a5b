"""Sync: deterministic bundles, hashes, manifests, newest-wins import and deltas."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = ("body", "embedding", "summary", "concepts")


def skeleton(nodes: DataFrame) -> DataFrame:
    """Nodes without the fields that stay local."""
    return nodes.drop(*HEAVY)


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's values, nulls apart from empty texts, lengths included so that no two rows read alike."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in columns)), 256)


def set_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(hash, n): a hash of the rows whatever their order, repeats counted.

    The row hashes are added up in four parts of 60 bits, and count and sums are hashed: partial sums are all that moves.
    """
    rows = df.select(row_hash(df, columns).alias("h"))
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(part(k)), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws(":", "n", *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("hash"), "n")


NODE_KEYS = ["node_id", "label", "qualified", "file_path", "content_hash"]
EDGE_KEYS = ["label", "from_id", "to_id"]


def manifest(nodes: DataFrame, edges: DataFrame, repo_slug: str) -> DataFrame:
    """One row: repo_slug, node_count, edge_count, hash of both."""
    n = set_hash(nodes, [c for c in NODE_KEYS if c in nodes.columns]).select(F.col("hash").alias("nh"), F.col("n").alias("node_count"))
    e = set_hash(edges, [c for c in EDGE_KEYS if c in edges.columns]).select(F.col("hash").alias("eh"), F.col("n").alias("edge_count"))
    return n.join(F.broadcast(e)).select(F.lit(repo_slug).alias("repo_slug"), "node_count", "edge_count", F.sha2(F.concat("nh", "eh"), 256).alias("hash"))


def sign(secret: str, digest: str) -> str:
    return hmac.new(secret.encode(), digest.encode(), hashlib.sha256).hexdigest()


def export_bundle(nodes: DataFrame, edges: DataFrame, repo_slug: str, path: str, secret: str | None = None) -> dict:
    """Write skeleton nodes, edges and a signed manifest below ``path``; the manifest comes back."""
    slim = skeleton(nodes)
    slim.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    row = manifest(slim, edges, repo_slug).first().asDict()
    if secret:
        row["signature"] = sign(secret, row["hash"])
    nodes.sparkSession.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return row


def read_bundle(spark, path: str, secret: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, edges and manifest of a bundle; fails if its hash or signature is not that of its content."""
    row = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if manifest(nodes, edges, row["repo_slug"]).first()["hash"] != row["hash"]:
        raise ValueError("the bundle's hash does not match its content")
    if secret is not None and not hmac.compare_digest(sign(secret, row["hash"]), row.get("signature", "")):
        raise ValueError("the bundle's signature does not match")
    return nodes, edges, row


def in_scope(repo_slug: str, scope: list[str]) -> bool:
    """Whether a scope (slugs, or ``owner/*``) lets a repository through; an empty scope lets none."""
    return any(s == repo_slug or (s.endswith("/*") and repo_slug.startswith(s[:-1])) for s in scope)


def merge_import(local: DataFrame, incoming: DataFrame, keys: list[str], hash_column: str = "content_hash", time_column: str = "last_modified_at", keep: tuple[str, ...] = HEAVY) -> DataFrame:
    """Local rows after an import, with ``action``: inserted, updated, unchanged (equal hash), older, or local.

    An incoming row wins only if its hash differs and it is newer; local values of ``keep`` survive.
    """
    a, b = local.alias("a"), incoming.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    here, there = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    same = F.col(f"a.{hash_column}").eqNullSafe(F.col(f"b.{hash_column}"))
    newer = F.coalesce(F.col(f"b.{time_column}") > F.col(f"a.{time_column}"), F.col(f"a.{time_column}").isNull() & F.col(f"b.{time_column}").isNotNull())
    action = F.when(~there, "local").when(~here, "inserted").when(same, "unchanged").when(newer, "updated").otherwise("older")
    take = action.isin("inserted", "updated")
    columns = []
    for c in local.columns:
        mine, other = F.col(f"a.{c}"), F.col(f"b.{c}") if c in incoming.columns else F.lit(None)
        columns.append((F.coalesce(mine, other) if c in keep else F.when(take, other).otherwise(mine)).alias(c))
    return joined.select(*columns, action.alias("action"))


def delta(local: DataFrame, remote_hashes: DataFrame, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """Local rows that the other side (keys, hash) lacks or has with another hash."""
    return local.join(remote_hashes.select(*keys, hash_column), [*keys, hash_column], "left_anti")


def needs_pull(local_manifest: dict | None, remote_manifest: dict) -> bool:
    return local_manifest is None or local_manifest.get("hash") != remote_manifest["hash"]


def push(nodes: DataFrame, edges: DataFrame, repo_slug: str, path: str, scope: list[str], secret: str | None = None, remote_manifest: dict | None = None) -> dict | None:
    """Export a repository that the scope lets through, unless the other side's manifest has its hash already; the new
    manifest, or None where nothing was to be sent."""
    if not in_scope(repo_slug, scope):
        raise PermissionError(f"{repo_slug} is not in scope")
    if remote_manifest is not None and remote_manifest.get("hash") == manifest(skeleton(nodes), edges, repo_slug).first()["hash"]:
        return None
    return export_bundle(nodes, edges, repo_slug, path, secret)


def pull(nodes: DataFrame, edges: DataFrame, repo_slug: str, path: str, scope: list[str], secret: str | None = None) -> tuple[DataFrame, DataFrame, dict] | None:
    """(nodes with ``action``, edges, manifest) after a verified bundle at ``path`` is taken in, newest first; None where
    the local manifest has the bundle's hash.  Edges of both sides stay, equal ones once."""
    if not in_scope(repo_slug, scope):
        raise PermissionError(f"{repo_slug} is not in scope")
    spark = nodes.sparkSession
    remote = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if not needs_pull(manifest(skeleton(nodes), edges, repo_slug).first().asDict(), remote):
        return None
    theirs, their_edges, remote = read_bundle(spark, path, secret)
    merged = merge_import(nodes, theirs, ["repo_slug", "node_id"])
    keys = [c for c in EDGE_KEYS if c in edges.columns]
    new = their_edges.join(edges.select(*keys).distinct(), keys, "left_anti")
    return merged, edges.unionByName(new, allowMissingColumns=True), remote
