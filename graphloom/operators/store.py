"""The graph store: scans, lookups, upserts, cascading deletes and the change log, on Parquet.

Frames are transformed by pure functions; ``GraphStore`` keeps them in ``SegmentTable``s by repository and label:
edges are appended, other changes rewrite only the (repository, label) pairs that they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.joins import dealt
from graphloom.operators.tables import SegmentTable
from graphloom.storage import cut


def scan_nodes(nodes: DataFrame, repo_slug: str | None = None, labels: list[str] | None = None, file_path: str | None = None,
               file_path_prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by repository, label, path or path prefix, in id order where limited."""
    for column, value in (("repo_slug", repo_slug), ("file_path", file_path)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    if labels:
        nodes = nodes.where(F.col("label").isin(*labels))
    if file_path_prefix:
        nodes = nodes.where(F.col("file_path").startswith(file_path_prefix))
    return nodes if limit is None else nodes.orderBy("node_id").limit(limit)


def scan_edges(edges: DataFrame, labels: list[str] | None = None, repo_slug: str | None = None) -> DataFrame:
    if repo_slug is not None:
        edges = edges.where(F.col("repo_slug") == repo_slug)
    return edges.where(F.col("label").isin(*labels)) if labels else edges


LOOKUP_ORDER = ("function", "class", "module", "file")


def find_by_qualified(nodes: DataFrame, symbol: str) -> DataFrame:
    """At most one node: by qualified name, tables in ``LOOKUP_ORDER``; a symbol without a dot also by plain name."""
    hit = F.when(F.col("qualified") == symbol, 1)
    if "." not in symbol:
        hit = hit.when(F.col("name") == symbol, 2)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LOOKUP_ORDER)), F.col("label")), F.lit(99))
    rank = F.when(rank == 0, 99).otherwise(rank)
    return nodes.withColumns({"__hit": hit, "__rank": rank}).where("__hit is not null").orderBy("__hit", "__rank", "node_id").limit(1).drop("__hit", "__rank")


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """(node_id, qualified, file_path, start_line, status): an exact match, else those whose name ends in ``.symbol``.

    The status is ``exact``, ``suffix`` (one) or ``ambiguous`` (several).
    """
    exact = F.col("qualified") == symbol
    if "." not in symbol:
        exact = exact | (F.col("name") == symbol) & ~F.col("qualified").contains(".")
    found = nodes.where(exact | F.col("qualified").endswith(f".{symbol}")).withColumn("__exact", exact)
    # matches of one symbol are few; where they are not they are still only a count and a filter
    any_ = found.agg(F.max("__exact").alias("some_exact"), F.count("*").alias("n"))
    status = F.when(F.col("some_exact"), "exact").when(F.col("n") == 1, "suffix").otherwise("ambiguous")
    return found.join(F.broadcast(any_)).where(~F.col("some_exact") | F.col("__exact")).select("node_id", "qualified", "file_path", "start_line", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both by key, the new one where both have it; of several new rows the last by ``order``, ties by content."""
    ranked = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    content = F.xxhash64(*(c for c, t in ranked.dtypes if c != "__batch" and "map<" not in t))
    by = [F.col("__batch").desc(), *([F.col(order).desc()] if order else []), content]
    return ranked.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n", "__batch")


def merge_update(nodes: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``nodes`` with the non-null values of ``columns`` in ``changes`` (one row a key) in place of their own."""
    new = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = nodes.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns))


def cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (node_id), and edges without those that had an end among them."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.select(*edges.columns)


def stale_nodes(nodes: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Nodes whose file is no longer among ``on_disk`` (file_path); those without a file are never stale."""
    return nodes.where("file_path is not null and file_path <> ''").join(on_disk.select("file_path"), "file_path", "left_anti").select(*nodes.columns)


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (repo_slug, file_path, content_hash) that are new or whose hash differs from the stored file node's."""
    known = stored.select("repo_slug", "file_path", F.col("content_hash").alias("__old")).dropDuplicates(["repo_slug", "file_path"])
    return files.join(known, ["repo_slug", "file_path"], "left").where(~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")


#: what a generated value was made from: where it differs the value is out of date
MADE_FROM = ("body", "signature", "docstring")


def keep_generated(parsed: DataFrame, stored: DataFrame, columns: tuple[str, ...] = ("summary", "concepts", "embedding"), made_from: tuple[str, ...] = MADE_FROM) -> DataFrame:
    """Freshly parsed nodes with the stored values of generated columns where they have none and are otherwise the same."""
    old = stored.select("repo_slug", "node_id", *(F.col(c).alias(f"__{c}") for c in (*columns, *made_from)))
    joined = parsed.join(old, ["repo_slug", "node_id"], "left")
    same = F.lit(True)
    for c in made_from:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.select(*(F.coalesce(F.col(c), F.when(same, F.col(f"__{c}"))).alias(c) if c in columns else F.col(c) for c in parsed.columns))


def changes_since(log: DataFrame, since, limit: int = 1000, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The first ``limit`` entries of a change log at or after ``since``."""
    return log.where(F.col(order[0]) >= since).orderBy(*order).limit(limit)


def list_files(nodes: DataFrame, prefix: str = "", limit: int = 100) -> tuple[DataFrame, bool]:
    """File paths in order, at most ``limit`` (1000 at most), and whether there are more."""
    limit = max(1, min(limit, 1000))
    paths = nodes.where((F.col("file_path") != "") & F.col("file_path").startswith(prefix)).select("file_path").distinct().orderBy("file_path").limit(limit + 1)
    return paths.limit(limit), paths.count() > limit


def snapshot(nodes: DataFrame, edges: DataFrame, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """A light view: up to ``limit`` (5000 at most) nodes in id order and the edges among them."""
    light = nodes.select("node_id", "label", "name", "qualified", "file_path").orderBy("node_id").limit(max(1, min(limit, 5000)))
    ids = F.broadcast(light.select("node_id"))  # at most 5000 ids
    among = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return light, among.select("label", "from_id", "to_id")


def concept_search(nodes: DataFrame, concepts: list[str], limit: int) -> DataFrame:
    """Nodes with any of the concepts, at most ``limit`` of each label, in id order."""
    hit = nodes.where(F.arrays_overlap("concepts", F.array(*map(F.lit, concepts))))
    return hit.withColumn("__n", F.row_number().over(W.partitionBy("label").orderBy("node_id"))).where(F.col("__n") <= limit).drop("__n")


class GraphStore:
    """Nodes, edges, repositories and a change log under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        table = lambda name, ddl, by=("repo_slug", "label"): SegmentTable(spark, f"{self.path}/{name}", ddl, by)
        self.node_table, self.edge_table = table("nodes", schema.NODES), table("edges", schema.EDGES)
        self.repo_table = table("repos", schema.REPOS, ("slug", "slug"))

    @property
    def nodes(self) -> DataFrame:
        return self.node_table.read()

    @property
    def edges(self) -> DataFrame:
        return self.edge_table.read()

    @property
    def repos(self) -> DataFrame:
        return self.repo_table.read()

    # --- the change log -------------------------------------------------------------------------------------------

    def _logged(self, op: str, kind: str, rows: DataFrame) -> None:
        """One entry for each row, appended; ``streaming.changefeed.read_changes`` follows the folder."""
        id_, other = ("node_id", F.lit(None).cast("string")) if kind == "node" else ("from_id", F.col("to_id"))
        entries = rows.select(F.current_timestamp().alias("ts"), F.lit(kind).alias("kind"), F.lit(op).alias("op"), "repo_slug", "label", F.col(id_).alias("id"), other.alias("other"))
        entries.write.mode("append").parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        """The change log (ts, kind, op, repo_slug, label, id, other)."""
        from graphloom.storage import file_system

        fs, at = file_system(self.spark, f"{self.path}/log")
        return self.spark.read.schema(schema.LOG).parquet(f"{self.path}/log") if fs.exists(at) else self.spark.createDataFrame([], schema.LOG)

    def changes(self, since, limit: int = 1000) -> DataFrame:
        return changes_since(self.log(), since, limit, ("ts", "kind", "id"))

    # --- writing --------------------------------------------------------------------------------------------------

    def put_nodes(self, nodes: DataFrame) -> None:
        """Full replacement by (repo_slug, node_id); only the pairs of repository and label that come are rewritten."""
        new = cut(schema.conform(nodes, schema.NODES))
        pairs = self.node_table.pairs_of(new)
        if pairs:
            seen = self.node_table.version()[0]
            self.node_table.replace(upsert(self.node_table.of_pairs(pairs), new, ["repo_slug", "node_id"]), pairs, seen, new.count())
            self._logged("put", "node", new)

    def put_edges(self, edges: DataFrame, batch: str | None = None) -> None:
        """Appended: equal edges add up, but for those of a ``batch`` that comes again, which replaces itself."""
        new = cut(schema.conform(edges, schema.EDGES))
        if not new.isEmpty():
            self.edge_table.append(new, batch)
            self._logged("put", "edge", new)

    def stream_edges(self, batch: DataFrame) -> None:
        """The edge sink of ``write_graph``: a batch (``batch_id``) that is run again after a failure is stored once."""
        number = batch.select("batch_id").first()
        if number is not None:
            self.put_edges(batch.drop("batch_id"), f"stream-{number[0]}")

    def replace_edges(self, repo_slug: str, edges: DataFrame) -> None:
        """All edges of a repository anew; entries are logged for those that come or go."""
        seen = self.edge_table.version()[0]
        new, old = cut(schema.conform(edges, schema.EDGES)), self.edge_table.read(repo_slug)
        ends = ["repo_slug", "label", "from_id", "to_id"]
        added = new.count()
        by_ends = lambda df: dealt(df, max(added, old.count()), *ends)
        without = lambda rows, other: cut(by_ends(rows).join(by_ends(other.select(*ends)).distinct(), ends, "left_anti"))
        come, gone = without(new, old), without(old, new)
        pairs = [(s["repo"], s["label"]) for s in self.edge_table.version()[1] if s["repo"] == repo_slug]
        self.edge_table.replace(new, pairs, seen, added)
        self._logged("delete", "edge", gone)
        self._logged("put", "edge", come)

    def put_batch(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Nodes, then edges, as their ends must be there first."""
        self.put_nodes(nodes)
        self.put_edges(edges)

    def put_repo(self, repo: DataFrame) -> None:
        new = cut(schema.conform(repo, schema.REPOS))
        pairs = self.repo_table.pairs_of(new)
        self.repo_table.replace(upsert(self.repo_table.of_pairs(pairs), new, ["slug"]), pairs, new=new.count())

    def list_repos(self) -> DataFrame:
        return self.repos.orderBy("slug")

    def find_repo(self, remote_url: str) -> DataFrame:
        return self.repos.where(F.col("remote_url") == remote_url)

    # --- deleting -------------------------------------------------------------------------------------------------

    def delete(self, gone: DataFrame, edges: bool = True) -> None:
        """Nodes of ``gone`` (repo_slug, node_id) and, with ``edges``, all edges at them."""
        keys, seen_edges, seen_nodes = cut(gone.select("repo_slug", "node_id").distinct()), self.edge_table.version()[0], self.node_table.version()[0]
        if edges:
            at_either = None
            for end in ("from_id", "to_id"):
                hit = self.edges.join(keys.withColumnRenamed("node_id", end), ["repo_slug", end], "left_semi")
                at_either = hit if at_either is None else at_either.unionByName(hit)
            at_either = cut(at_either.select("repo_slug", "label", "from_id", "to_id"))
            pairs = self.edge_table.pairs_of(at_either)
            if pairs:
                rows = self.edge_table.of_pairs(pairs)
                for end in ("from_id", "to_id"):
                    rows = rows.join(keys.withColumnRenamed("node_id", end), ["repo_slug", end], "left_anti")
                self.edge_table.replace(rows, pairs, seen_edges)
                self._logged("delete", "edge", at_either.distinct())
        hit = cut(self.nodes.join(keys, ["repo_slug", "node_id"], "left_semi").select("repo_slug", "label", "node_id"))
        pairs = self.node_table.pairs_of(hit)
        if pairs:
            self.node_table.replace(self.node_table.of_pairs(pairs).join(keys, ["repo_slug", "node_id"], "left_anti"), pairs, seen_nodes)
            self._logged("delete", "node", hit)

    def delete_file(self, repo_slug: str, file_path: str) -> None:
        self.delete(scan_nodes(self.nodes, repo_slug, file_path=file_path))

    def delete_repo(self, repo_slug: str) -> None:
        """The repository's own segments go as a whole; nothing else is read."""
        none = self.spark.createDataFrame([], schema.NODES), self.spark.createDataFrame([], schema.EDGES), self.spark.createDataFrame([], schema.REPOS)
        for table, rows in zip((self.node_table, self.edge_table, self.repo_table), none):
            pairs = [(s["repo"], s["label"]) for s in table.version()[1] if s["repo"] == repo_slug]
            if pairs:
                table.replace(rows, pairs)

    def delete_edges_of(self, repo_slug: str, node_id: str) -> None:
        here = (F.col("from_id") == node_id) | (F.col("to_id") == node_id)
        seen = self.edge_table.version()[0]
        hit = cut(self.edge_table.read(repo_slug).where(here))
        pairs = self.edge_table.pairs_of(hit)
        if pairs:
            self.edge_table.replace(self.edge_table.of_pairs(pairs).where(~here), pairs, seen)
            self._logged("delete", "edge", hit)
