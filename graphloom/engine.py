"""The engine: index a repository into a store and answer questions about it.

``Engine`` ties the operators together.  Models that turn text into vectors or prose are callables given to it; without
them everything that needs none works.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import ids, paths
from graphloom.operators import adjacency, analyze, derive, link, lookup, memory, search, store, sync, traverse
from graphloom.operators.extract import runner
from graphloom.sources import files, gitlog
from graphloom.storage import cut, file_system
from graphloom.streaming import changefeed


#: stages of an index run, in order
INDEX_STAGES = ["walk", "parse", "link", "summarise", "embed", "store", "reembed"]
#: labels that are worked out from all nodes, and what a call's label was before its caller was known
DERIVED, CALL_LABELS = ("defines", "implements"), ("tests", "constructs")


class Engine:
    def __init__(self, spark: SparkSession, path: str, embed_fn: Callable[[list[str]], list[list[float]]] | None = None, explain_fn: Callable[[str], str] | None = None,
                 summarise_fn: Callable[[list[str]], list[tuple[str, list[str]]]] | None = None, on_delta: Callable[[DataFrame], None] | None = None, on_stage: Callable[[str, str], None] | None = None) -> None:
        """``summarise_fn`` gives a summary and concepts for each text; ``on_delta`` gets the rows of ``delta_rows`` that a run
        wrote or removed, ``on_stage`` each stage and its state."""
        self.spark, self.store, self.embed_fn, self.explain_fn = spark, store.GraphStore(spark, path), embed_fn, explain_fn
        self.summarise_fn, self.on_delta, self.on_stage = summarise_fn, on_delta, on_stage
        self.memory = memory.MemoryStore(spark, f"{path.rstrip('/')}/memory")
        self.tracker = changefeed.StageTracker(INDEX_STAGES)
        self._organised: tuple[tuple[int, int], str, adjacency.Adjacency] | None = None

    # --- organised copies -------------------------------------------------------------------------------------------

    def _versions(self) -> tuple[int, int]:
        return self.store.node_table.version()[0], self.store.edge_table.version()[0]

    def organise(self) -> None:
        """Copies of the stored graph for questions over all of it: nodes sorted by id with filters of names, edges bucketed by
        either end.  They answer while the store stays at the version that they were made from; after a write questions
        read the store itself until the next call."""
        before, path = self._organised, f"{self.store.path}/organised-{uuid.uuid4().hex}"
        versions = self._versions()
        lookup.save(self.nodes(), f"{path}/nodes")
        self._organised = versions, path, adjacency.save(self.edges(), f"{path}/edges")
        if before:
            before[2].drop()
            fs, at = file_system(self.spark, before[1])
            fs.delete(at, True)

    def _at_hand(self, repo_slug: str | None = None) -> tuple[str, adjacency.Adjacency] | None:
        """Folder of the nodes and the adjacency, where they stand for the graph that is asked."""
        if repo_slug is not None or self._organised is None or self._organised[0] != self._versions():
            return None
        return f"{self._organised[1]}/nodes", self._organised[2]

    # --- indexing ---------------------------------------------------------------------------------------------------

    def _stage(self, stage: str, state: str) -> None:
        self.tracker.move(stage, state)
        if self.on_stage:
            self.on_stage(stage, state)

    @contextmanager
    def _running(self, stage: str, wanted: bool = True):
        """Run a stage, or mark it skipped; a failure is noted and goes on."""
        if not wanted:
            self._stage(stage, "skipped")
            yield False
            return
        self._stage(stage, "running")
        try:
            yield True
        except Exception as e:
            self.tracker.error(stage, str(e))
            self._stage(stage, "failed")
            raise
        self._stage(stage, "completed")

    def repo_of(self, root: str, repo_slug: str | None = None) -> dict:
        """slug, remote_url, default_branch and last_commit of a working tree.

        A repository that is stored under its remote keeps its slug; else the slug is the one given, the remote's, or the
        folder's name.
        """
        known = gitlog.identity_of(root)
        row = {"slug": repo_slug, "remote_url": None, "default_branch": known.get("branch"), "last_commit": known.get("commit")}
        if known.get("remote"):
            found = gitlog.identity(self.spark.createDataFrame([(known["remote"],)], "remote string")).first()
            stored = self.store.find_repo(found.remote_url).orderBy("slug").first()
            row["remote_url"] = found.remote_url
            row["slug"] = stored.slug if stored else repo_slug or found.slug or None
        row["slug"] = row["slug"] or root.rstrip("/").rsplit("/", 1)[-1]
        return row

    def index(self, root: str, repo_slug: str | None = None, languages: list[str] | None = None, exclude: list[str] | None = None, force: bool = False, reparse: bool = False, fast: bool = False) -> DataFrame:
        """Walk, parse, link and store a repository; (label, processed, resolved, unresolved) of its edges comes back.

        Files whose content hash is stored are skipped, unless ``force`` (everything is deleted first) or ``reparse``.
        Only nodes that are no longer in their file, or whose file is gone, are deleted.  Edges out of parsed files are
        made anew; of the others those without a target, or whose target has gone, or whose name has other candidates than
        before, are resolved again over all nodes, and what finds none keeps what the source says, unresolved: edges are
        those of a full index.  ``fast`` leaves out summaries and embedding.
        """
        repo = self.repo_of(root, repo_slug)
        repo_slug = repo["slug"]
        self.tracker = changefeed.StageTracker(INDEX_STAGES)
        if force:
            self.store.delete_repo(repo_slug)
        old, old_edges = self.store.node_table.read(repo_slug), self.store.edge_table.read(repo_slug)
        with self._running("walk"):
            found = files.walk(self.spark, root, languages, exclude)
            file_nodes = schema.conform(files.file_nodes(found, repo_slug), schema.NODES)
            changed = cut(file_nodes if reparse else store.changed_files(file_nodes, old.where(F.col("label") == "file")))
            on_disk = cut(file_nodes.select("file_path"))
            todo = found.join(changed.select(F.col("file_path").alias("path")), "path", "left_semi")
        with self._running("parse"):
            parsed = cut(runner.parse_files(todo))
            self.tracker.counts["parse"] = parsed.where("part = 0").count()
            for r in parsed.where("error <> ''").select("path", "error").limit(changefeed.MOST_ERRORS).collect():
                self.tracker.error("parse", f"{r.path}: {r.error}")
            code = runner.merge_methods(runner.nodes_of(parsed, repo_slug))
            new = schema.conform(changed, schema.NODES).unionByName(schema.conform(code, schema.NODES)).unionByName(schema.conform(files.go_mod_nodes(todo, repo_slug), schema.NODES))
            new = cut(store.keep_generated(new, old).dropDuplicates(["repo_slug", "node_id"]))
        with self._running("link"):
            touched = changed.select("file_path")
            before = cut(old.join(touched, "file_path", "left_semi").select("node_id", "repo_slug"))  # what stood in the parsed files
            vanished = before.join(new.select("node_id"), "node_id", "left_anti").select("repo_slug", "node_id")
            drop = cut(store.stale_nodes(old, on_disk).select("repo_slug", "node_id").unionByName(vanished).distinct())
            columns = ["node_id", "label", "name", "qualified", "file_path", "methods"]
            kept = old.join(drop, ["repo_slug", "node_id"], "left_anti").join(new.select("node_id"), "node_id", "left_anti")
            symbols = cut(kept.select(*columns).unionByName(new.select(*columns)))
            made_anew = before.select("node_id").union(new.select("node_id")).union(drop.select("node_id")).distinct().withColumnRenamed("node_id", "from_id")
            others = old_edges.where(~F.col("label").isin(*DERIVED)).join(made_anew, "from_id", "left_anti")
            dangling = others.join(drop.select(F.col("node_id").alias("to_id"), F.lit(True).alias("__gone")), "to_id", "left")
            # names that have other candidates than before: those of all nodes in parsed or vanished files, as they were and are
            stood = old.join(before.select("node_id").union(drop.select("node_id")).distinct(), "node_id", "left_semi")
            moved = cut(stood.select("label", "qualified").unionByName(new.select("label", "qualified")).where("qualified <> ''").select("label", ids.suffix_of(F.col("qualified")).alias("__suffix")).distinct())
            dangling = dangling.withColumn("__suffix", ids.suffix_of(F.col("target"))).join(moved.select("__suffix", F.lit(True).alias("__moved")).distinct(), "__suffix", "left").drop("__suffix")
            # what is read and written is looked for by its type
            types = not moved.where(F.col("label") == "class").isEmpty()
            again = F.coalesce("__gone", F.lit(False)) | ~F.coalesce(F.col("resolved"), F.lit(True)) | F.coalesce("__moved", F.lit(False)) | (F.lit(types) & F.col("label").isin("reads", "writes"))
            again = again & (F.col("target").isNotNull() | F.coalesce("__gone", F.lit(False)) | ~F.coalesce(F.col("resolved"), F.lit(True)))
            dangling = cut(dangling.withColumn("__again", again).drop("__gone", "__moved"))
            stay = schema.conform(dangling.where(~F.col("__again")), schema.EDGES)
            raw_label = F.when(F.col("label").isin(*CALL_LABELS), "calls").otherwise(F.col("label"))
            raw = dangling.where(F.col("__again") & F.col("target").isNotNull()).withColumns({"label": raw_label, "to_id": F.col("target")}).drop("__again", "resolved")
            fresh = runner.edges_of(parsed, repo_slug)
            linked = link.link_all(fresh.unionByName(raw, allowMissingColumns=True), symbols).withColumn("repo_slug", F.lit(repo_slug))
            linked = cut(schema.conform(linked, schema.EDGES))
        with self._running("summarise", bool(self.summarise_fn) and not fast) as wanted:
            if wanted:
                new = cut(self._summarised(new))
        with self._running("embed", bool(self.embed_fn) and not fast) as wanted:
            if wanted:
                new = cut(self._embedded(new))
        with self._running("store"):
            removed = cut(self.store.nodes.join(drop, ["repo_slug", "node_id"], "left_semi"))
            if not drop.isEmpty():
                self.store.delete(drop, edges=False)
            self.store.put_nodes(new)
            self.store.replace_edges(repo_slug, stay.unionByName(linked))
            row = self.spark.createDataFrame([(repo_slug, root, repo["remote_url"], repo["default_branch"], repo["last_commit"])], "slug string, path string, remote_url string, default_branch string, last_commit string")
            self.store.put_repo(row.withColumn("last_indexed_at", F.current_timestamp()))
            self.tracker.counts["store"] = new.count()
        if self.on_delta:
            self.on_delta(changefeed.delta_rows(removed, linked.where("false"), "delete").unionByName(changefeed.delta_rows(new, linked)))
        with self._running("reembed", bool(self.embed_fn) and not fast) as wanted:
            if wanted:
                self.reembed(repo_slug, new, linked)
        return link.link_stats(linked)

    def _summarised(self, nodes: DataFrame, force: bool = False) -> DataFrame:
        said = search.summarise_missing(nodes, self.summarise_fn, force=force).select("node_id", F.col("summary").alias("__summary"), F.col("concepts").alias("__concepts"))
        made = {"summary": F.coalesce("__summary", "summary"), "concepts": F.coalesce("__concepts", "concepts")}
        return nodes.join(said, "node_id", "left").withColumns(made).select(*nodes.columns)

    def _embedded(self, nodes: DataFrame, force: bool = False) -> DataFrame:
        text = search.context_text(search.embed_budget(2000), F.col("label"), F.col("qualified"), F.col("summary"), F.col("docstring"), F.col("concepts"), F.col("signature"), F.col("body"))
        made = search.embed_missing(nodes, text, self.embed_fn, force=force).withColumnRenamed("embedding", "__new")
        return nodes.join(made, "node_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new").select(*nodes.columns)

    def reembed(self, repo_slug: str, nodes: DataFrame, edges: DataFrame, force: bool = False) -> int:
        """Vectors for changed nodes and both ends of changed edges that have none, or for all of them with ``force``; how many."""
        ids = search.to_reembed(nodes, edges)
        todo = self.store.node_table.read(repo_slug).join(ids, "node_id", "left_semi")
        todo = cut(todo if force else todo.where("embedding is null"))
        n = todo.count()
        if n:
            self.store.put_nodes(self._embedded(todo, force))
        return n

    def summarise(self, repo_slug: str, force: bool = False) -> int:
        """Summaries and concepts of stored nodes that need them (or all, with ``force``); how many nodes have got one."""
        nodes = self.store.node_table.read(repo_slug)
        done = cut(self._summarised(nodes, force).join(nodes.select("node_id", F.col("summary").alias("__old")), "node_id").where(~F.col("summary").eqNullSafe(F.col("__old"))).drop("__old"))
        n = done.count()
        if n:
            self.store.put_nodes(done)
        return n

    def index_history(self, root: str, repo_slug: str, first: str | None = None) -> DataFrame:
        """(key, hash, ts, change) of the nodes that each commit of a range added or modified.

        Every version of a touched file is parsed; stored nodes get their introduced and last modified commits, stored
        edges the commit that first shows them.
        """
        versions = gitlog.file_versions(self.spark, root, first)
        rows = versions.where("content is not null").withColumn("language", paths.language_of(F.col("path"))).where("language is not null")
        parsed = cut(runner.parse_files(rows, carry=("hash", "ts", "status")))
        nodes = parsed.select("hash", "ts", "status", F.explode("nodes").alias("n"))
        seen = nodes.select(F.col("n.node_id").alias("key"), "hash", "ts", F.sha2(F.coalesce("n.body", F.lit("")), 256).alias("content_hash"), "status").dropDuplicates(["key", "hash"])
        changes = cut(analyze.index_commits(seen))
        stored, of = self.store.node_table.read(repo_slug), changes.select(F.col("key").alias("node_id"), "hash", "ts")
        self.store.put_nodes(analyze.temporal_upsert(stored.join(of, "node_id", "left_semi"), of))
        edges = parsed.select("hash", "ts", F.explode("edges").alias("e")).groupBy(F.col("e.from_id").alias("from_id"), F.col("e.to_id").alias("target")).agg(F.min(F.struct("ts", "hash")).alias("first"))
        every = self.store.edge_table.read(repo_slug).join(edges, ["from_id", "target"], "left")
        dated = every.withColumns({"introduced_commit": F.coalesce("introduced_commit", "first.hash"), "introduced_at": F.coalesce("introduced_at", "first.ts")})
        self.store.replace_edges(repo_slug, schema.conform(dated, schema.EDGES))
        return changes

    # --- sync -------------------------------------------------------------------------------------------------------

    def push(self, repo_slug: str, path: str, scope: list[str], secret: str | None = None, remote_manifest: dict | None = None) -> dict | None:
        """Write a repository's bundle unless the other side has it; the manifest, or None."""
        return sync.push(self.nodes(repo_slug), self.edges(repo_slug), repo_slug, path, scope, secret, remote_manifest)

    def pull(self, repo_slug: str, path: str, scope: list[str], secret: str | None = None) -> dict[str, int] | None:
        """Take a verified bundle in; how many nodes were inserted, updated and so on, or None where nothing differs."""
        taken = sync.pull(self.nodes(repo_slug), self.edges(repo_slug), repo_slug, path, scope, secret)
        if taken is None:
            return None
        nodes, edges, _ = taken
        nodes, edges = cut(nodes), cut(edges)
        self.store.put_nodes(nodes.where("action in ('inserted', 'updated')"))
        self.store.replace_edges(repo_slug, edges)
        return {r.action: r["count"] for r in nodes.groupBy("action").count().collect()}

    # --- questions --------------------------------------------------------------------------------------------------

    def nodes(self, repo_slug: str | None = None) -> DataFrame:
        return self.store.node_table.read(repo_slug)

    def edges(self, repo_slug: str | None = None, labels: list[str] | None = None) -> DataFrame:
        return self.store.edge_table.read(repo_slug, labels)

    def _seed(self, symbol: str, repo_slug: str | None = None) -> DataFrame:
        """(seed_id, node_id) of a symbol; an ambiguous one is an error that names the candidates."""
        found = store.resolve_symbol(self.nodes(repo_slug), symbol).orderBy("node_id").limit(10).collect()
        if not found and self.embed_fn:
            hit = search.vector_search(self.nodes(repo_slug), self.embed_fn([symbol])[0], 1, 0.8).collect()
            found = hit
        elif len(found) > 1 and found[0].status == "ambiguous":
            raise LookupError(f"{symbol} is ambiguous: " + ", ".join(f"{r.qualified} ({r.file_path}:{r.start_line})" for r in found))
        return self.spark.createDataFrame([(symbol, r.node_id) for r in found], "seed_id string, node_id string")

    def lookup(self, symbol: str, repo_slug: str | None = None) -> DataFrame:
        at_hand = self._at_hand(repo_slug)
        return lookup.find(self.spark, at_hand[0], symbol) if at_hand else store.find_by_qualified(self.nodes(repo_slug), symbol)

    def show_node(self, node_id: str) -> DataFrame:
        at_hand = self._at_hand()
        return lookup.by_id(self.spark, at_hand[0], [node_id]) if at_hand else self.store.nodes.where(F.col("node_id") == node_id)

    def neighborhood(self, symbol: str, repo_slug: str | None = None) -> DataFrame:
        return traverse.neighbours(self.edges(repo_slug), self.nodes(repo_slug), self._seed(symbol, repo_slug))

    def trace(self, symbol: str, labels: list[str] = ("calls",), direction: str = "forward", max_depth: int = 5, repo_slug: str | None = None) -> DataFrame:
        return analyze.trace(self._seed(symbol, repo_slug), self.edges(repo_slug), self.nodes(repo_slug), list(labels), direction, max_depth, sites=True)

    def blast(self, symbol: str, max_depth: int = 0, repo_slug: str | None = None) -> DataFrame:
        at_hand = self._at_hand(repo_slug)
        return analyze.blast_radius(self._seed(symbol, repo_slug), at_hand[1] if at_hand else self.edges(repo_slug), self.nodes(repo_slug), max_depth=max_depth)

    def diff_impact(self, diffs: DataFrame, repo_slug: str | None = None) -> DataFrame:
        at_hand = self._at_hand(repo_slug)
        return analyze.diff_impact(diffs, at_hand[1] if at_hand else self.edges(repo_slug), self.nodes(repo_slug))

    def field_flow(self, symbol: str, field_path: str | None = None, show_mutations: bool = False, max_depth: int = 10, repo_slug: str | None = None) -> DataFrame:
        return analyze.field_flow_chains(self._seed(symbol, repo_slug), self.edges(repo_slug), field_path, max_depth, show_mutations)

    def field_flow_hops(self, symbol: str, field_path: str | None = None, max_depth: int = 10, repo_slug: str | None = None) -> DataFrame:
        return analyze.field_flow_hops(self._seed(symbol, repo_slug), self.edges(repo_slug), field_path, max_depth)

    def data_flow_context(self, symbol: str, repo_slug: str | None = None) -> DataFrame:
        return analyze.data_flow_context(self.edges(repo_slug), self.nodes(repo_slug), self._seed(symbol, repo_slug))

    def openapi(self, title: str = "api", version: str = "1.0.0", repo_slug: str | None = None) -> DataFrame:
        return analyze.openapi(self.api_surface(repo_slug), title, version)

    def tests_for(self, symbol: str, direct: bool = False, repo_slug: str | None = None) -> DataFrame:
        return analyze.tests_for(self._seed(symbol, repo_slug), self.edges(repo_slug), self.nodes(repo_slug), direct)

    def subjects_for(self, symbol: str, repo_slug: str | None = None) -> DataFrame:
        return analyze.subjects_for(self._seed(symbol, repo_slug), self.edges(repo_slug), self.nodes(repo_slug))

    def resolve_interface(self, symbol: str, bindings: bool = False, repo_slug: str | None = None) -> DataFrame:
        return analyze.resolve_interface(self._seed(symbol, repo_slug), self.edges(repo_slug), self.nodes(repo_slug), bindings)

    def api_surface(self, repo_slug: str | None = None) -> DataFrame:
        return analyze.api_surface(self.edges(repo_slug, ["route", "data_flow"]), self.nodes(repo_slug))

    def scan_security(self, repo_slug: str | None = None, severity: str = "low") -> DataFrame:
        """(node_id, category, severity): missing authentication and tainted sinks, of a severity or above."""
        nodes, edges = self.nodes(repo_slug), self.edges(repo_slug)
        gaps = analyze.auth_gaps(nodes, edges).select("node_id", "category", "severity")
        return analyze.at_least(gaps.unionByName(analyze.taint_findings(nodes, edges).select("node_id", "category", "severity")), severity)

    def similar_to(self, symbol: str, k: int = 10, repo_slug: str | None = None) -> DataFrame:
        row = self.nodes(repo_slug).join(self._seed(symbol, repo_slug).select("node_id"), "node_id", "left_semi").select("node_id", "embedding").first()
        return search.similar_to(self.nodes(repo_slug), row.node_id, list(row.embedding), k)

    def query_stages(self, question: str, top_k: int = 0, min_score: float = 0.0, file_prefix: str | None = None, repo_slug: str | None = None) -> Iterator[tuple[str, DataFrame]]:
        """The hybrid query stage by stage; the last is ``done``."""
        nodes, edges = self.nodes(repo_slug), self.edges(repo_slug)
        centrality = derive.degrees(nodes, edges).select("node_id", "centrality")
        return search.hybrid_stages(nodes, edges, centrality, question, self.embed_fn([question])[0], top_k, min_score, file_prefix)

    def query(self, question: str, **how) -> DataFrame:
        for _, frame in self.query_stages(question, **how):
            pass
        return frame

    def explain(self, question: str, **how) -> str:
        """What the explaining model says to a question and the best hits' bodies."""
        hits = self.query(question, **how).join(self.store.nodes.select("node_id", "qualified", "body"), "node_id").orderBy(F.desc("score")).collect()
        return self.explain_fn("\n\n".join([question, *(f"{r.qualified}\n{(r.body or '')[:2000]}" for r in hits)]))

    def find_root_cause(self, question: str, commits: DataFrame, as_of, since=None, repo_slug: str | None = None) -> DataFrame:
        located = self.query(question, top_k=10, repo_slug=repo_slug)
        return analyze.root_cause(located, self.edges(repo_slug), self.nodes(repo_slug), commits, F.lit(as_of), since)

    def list_repos(self) -> DataFrame:
        return self.store.list_repos()

    def list_files(self, prefix: str = "", limit: int = 100, repo_slug: str | None = None) -> tuple[DataFrame, bool]:
        return store.list_files(self.nodes(repo_slug), prefix, limit)

    def index_status(self, as_of=None) -> DataFrame:
        """(slug, last_indexed_at, is_stale, nodes, edges) of each repository."""
        when = F.lit(as_of) if as_of is not None else F.current_timestamp()
        count = lambda df, name: df.groupBy(F.col("repo_slug").alias("slug")).agg(F.count("*").alias(name))
        out = self.store.repos.join(count(self.store.nodes, "nodes"), "slug", "left").join(count(self.store.edges, "edges"), "slug", "left")
        return out.select("slug", "last_indexed_at", derive.is_stale(F.col("last_indexed_at"), when).alias("is_stale"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))

    def plan_analysis(self, repo_slug: str | None = None) -> DataFrame:
        """(kind, value, n): counts of languages, node labels and endpoints, for planning an analysis."""
        return plan_counts(self.nodes(repo_slug), self.edges(repo_slug))


def plan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by = lambda kind, c: nodes.where(F.col(c).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    routes = edges.where(F.col("label") == "route").groupBy(F.lit("endpoint").alias("kind"), F.lit("route").alias("value")).agg(F.count("*").alias("n"))
    return by("language", "language").unionByName(by("label", "label")).unionByName(routes)
