"""Analyses over the graph: trace, blast radius, diff impact, tests, interfaces, API surface, security, history."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import ids, paths
from graphloom.operators import link, ranges, traverse
from graphloom.operators.adjacency import SENT_FRONTIER
from graphloom.storage import cut

# --- trace and blast radius -----------------------------------------------------------------------------------------


def trace(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, labels: list[str] = ("calls",), direction: str = "forward", max_depth: int = 5, sites: bool = False) -> DataFrame:
    """Hops from ``seeds`` (seed_id, node_id), one for each qualified name, the nearest.

    The hops of a deep search are counted; names and call sites of a bounded number of them are looked up without moving all
    nodes and edges.
    """
    hops = traverse.traverse(seeds, edges, labels, direction, max_depth)
    if (max_depth if max_depth > 0 else traverse.DEFAULT_DEPTH) >= traverse.EAGER_FROM:
        hops = cut(hops)
        if hops.count() <= SENT_FRONTIER:
            reached = F.broadcast(hops.select("node_id").distinct())
            nodes = nodes.join(reached, "node_id", "left_semi")
            edges = edges.join(reached.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi")
    out = traverse.first_by_qualified(hops, nodes)
    return link.first_call_site(out, edges) if sites else out


BLAST_DEPTH, BLAST_CAP = 3, 5


def blast_radius(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, labels: list[str] = ("calls",), max_depth: int = 0) -> DataFrame:
    """Who depends on ``seeds`` (node_id): (node_id, qualified, module, file_path, hop), nearest first, then by name.

    The default depth is 3 and the most is 5.  All seeds are searched at once.
    """
    depth = min(max_depth if max_depth > 0 else BLAST_DEPTH, BLAST_CAP)
    start = seeds.select(F.lit("*").alias("seed_id"), "node_id")
    hops = traverse.min_hop(traverse.traverse(start, edges, labels, "reverse", depth, via=False))
    found = hops.join(nodes.select("node_id", "qualified", "file_path"), "node_id")
    return found.select("node_id", "qualified", ids.package_of(F.col("qualified")).alias("module"), "file_path", "hop").orderBy("hop", "qualified", "node_id")


# --- diff impact ----------------------------------------------------------------------------------------------------


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """(file_path, start, end) of changed new-side lines; a file without any (deleted, binary) gives one with nulls.

    A deleted file is looked up by its old path, any other by its new one.
    """
    path = F.when((F.col("status") == "deleted") & (F.coalesce("old_path", F.lit("")) != ""), F.col("old_path")).otherwise(F.col("path"))
    return diffs.select(path.alias("file_path"), F.explode_outer(paths.hunks(F.coalesce("patch", F.lit("")))).alias("h")).select("file_path", "h.start", "h.end")


def diff_impact(diffs: DataFrame, edges: DataFrame, nodes: DataFrame, labels: list[str] = ("calls",), max_depth: int = 0) -> DataFrame:
    """(node_id, qualified, file_path, hop, role): changed symbols (hop 0) and what depends on them, production or test.

    One search from all changed symbols at once; a changed symbol is not affected by itself or others.
    """
    changed = cut(ranges.overlapping(nodes.where(F.col("label").isin("function", "class")), diff_ranges(diffs)).select("node_id", "qualified", "file_path"))
    hit = blast_radius(changed.select("node_id"), edges, nodes, labels, max_depth).join(changed.select("node_id"), "node_id", "left_anti")
    test = F.coalesce(F.col("file_path").contains("_test.go"), F.lit(False))
    rows = changed.select("node_id", "qualified", "file_path", F.lit(0).alias("hop"), F.lit("changed").alias("role"))
    return rows.unionByName(hit.select("node_id", "qualified", "file_path", "hop", F.when(test, "test").otherwise("affected").alias("role"))).orderBy("hop", "qualified", "node_id")


# --- tests, interfaces ----------------------------------------------------------------------------------------------


def tests_for(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, direct: bool = False) -> DataFrame:
    """(node_id, qualified, hop): tests that reach ``seeds`` (node_id) over tests edges, at one hop or up to five."""
    start = seeds.select(F.lit("*").alias("seed_id"), "node_id")
    hops = traverse.min_hop(traverse.traverse(start, edges, ["tests"], "reverse", 1 if direct else 5, via=False))
    return _nearest_by_name(hops.join(nodes.select("node_id", "qualified"), "node_id"))


def subjects_for(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int = 5) -> DataFrame:
    """(node_id, qualified, hop): what the tests ``seeds`` exercise over tests and calls edges, tests themselves left out."""
    start = seeds.select(F.lit("*").alias("seed_id"), "node_id")
    hops = traverse.min_hop(traverse.traverse(start, edges, ["tests", "calls"], "forward", max_depth, via=False))
    named = hops.join(nodes.select("node_id", "qualified", "file_path", "name"), "node_id")
    return _nearest_by_name(named.where(~ids.looks_like_test(F.col("file_path"), F.col("name"))))


def _nearest_by_name(hops: DataFrame) -> DataFrame:
    key = F.coalesce(F.when(F.col("qualified") != "", F.col("qualified")), F.col("node_id"))
    best = hops.groupBy(key.alias("key")).agg(F.min(F.struct("hop", "node_id", "qualified")).alias("b"))
    return best.select("b.node_id", "b.qualified", "b.hop").orderBy("hop", "qualified", "node_id")


def resolve_interface(ifaces: DataFrame, edges: DataFrame, nodes: DataFrame, bindings: bool = False) -> DataFrame:
    """(node_id, qualified, role): types that implement ``ifaces`` (node_id) and, with ``bindings``, who builds or calls
    them within two hops."""
    start = ifaces.select(F.lit("*").alias("seed_id"), "node_id")
    types = traverse.min_hop(traverse.traverse(start, edges, ["implements"], "reverse", 1, via=False)).select("node_id")
    out = types.withColumn("role", F.lit("implementation"))
    if bindings:
        sites = traverse.min_hop(traverse.traverse(types.select(F.lit("*").alias("seed_id"), "node_id"), edges, ["constructs", "calls"], "reverse", 2, via=False))
        out = out.unionByName(sites.select("node_id", F.lit("binding").alias("role")))
    return out.join(nodes.select("node_id", "qualified"), "node_id").select("node_id", "qualified", "role").orderBy("role", "qualified", "node_id")


# --- API surface ------------------------------------------------------------------------------------------------

#: fixed values: words of authentication middleware
AUTH_WORDS = ("auth", "jwt", "session", "guard", "token", "bearer", "oauth", "passport")
#: fixed values: patterns of personal data and their kinds
PII = {
    "email": "email", "phone": "phone", "mobile": "phone", "ssn": "ssn", "social_security": "ssn", "tax_id": "ssn", "password": "credential",
    "passwd": "credential", "secret": "credential", "token": "credential", "api_key": "credential", "credit_card": "financial", "card_number": "financial",
    "cvv": "financial", "date_of_birth": "personal", "dob": "personal", "birth_date": "personal", "address": "address", "street": "address",
    "zip_code": "address", "postal": "address",
}


def pii_kind(name: Column) -> Column:
    """Kind of personal data that a name suggests: the first pattern, in the order of ``PII``, that it contains; null if none."""
    out, lower = F.lit(None).cast("string"), F.lower(name)
    for pattern, kind in reversed(PII.items()):
        out = F.when(lower.contains(pattern), F.lit(kind)).otherwise(out)
    return out


def auth_chain(middleware: Column) -> Column:
    """The middleware names (an array) that look like authentication."""
    words = "|".join(AUTH_WORDS)
    return F.filter(middleware, lambda m: F.lower(m).rlike(words))


def api_surface(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of route edges: method, path, handler, file, line, middleware, auth_chain, has_auth, params, responses, pii.

    Parameters and response types come from the handler's own data_flow binding edges.
    """
    prop = lambda k: F.try_element_at("props", F.lit(k))
    parts = F.filter(F.transform(F.split(F.coalesce(prop("middleware"), F.lit("")), ","), lambda m: F.trim(m)), lambda m: m != "")
    routes = edges.where(F.col("label") == "route").select(
        F.upper(prop("http_method")).alias("method"), prop("http_path").alias("path"), F.col("to_id").alias("handler_id"), F.substring_index("call_site", ":", 1).alias("file"),
        F.when(F.instr("call_site", ":") > 0, F.substring_index(F.substring("call_site", F.instr("call_site", ":") + 1, F.length("call_site")), ":", 1)).try_cast("int").alias("line"), parts.alias("middleware"),
    )
    bound = edges.where((F.col("label") == "data_flow") & prop("source_type").isNotNull()).groupBy(F.col("from_id").alias("handler_id")).agg(
        F.sort_array(F.collect_set(F.when(prop("source_type").isin("path_param", "query_param", "request_body"), F.coalesce(prop("param_name"), prop("bound_type"))))).alias("params"),
        F.sort_array(F.collect_set(F.when(prop("source_type") == "response", F.coalesce(prop("response_expr"), prop("bound_type"))))).alias("responses"),
    )
    named = nodes.select(F.col("node_id").alias("handler_id"), F.col("qualified").alias("handler"))
    out = routes.join(named, "handler_id", "left").join(bound, "handler_id", "left")
    empty = F.array().cast("array<string>")
    exposed = lambda c: F.filter(F.transform(c, lambda r: F.struct(r.alias("field"), pii_kind(r).alias("kind"))), lambda s: s["kind"].isNotNull())
    return out.select(
        "method", "path", F.coalesce("handler", "handler_id").alias("handler"), "file", "line", "middleware", auth_chain(F.col("middleware")).alias("auth_chain"),
        (F.size(auth_chain(F.col("middleware"))) > 0).alias("has_auth"), F.coalesce("params", empty).alias("params"), F.coalesce("responses", empty).alias("responses"),
        exposed(F.coalesce("responses", empty)).alias("pii"),
    )


def openapi(surface: DataFrame, title: str = "api", version: str = "1.0.0") -> DataFrame:
    """One row with the OpenAPI 3.0 document of an API surface, as JSON; of equal path and method the last handler counts.

    A document is one text: a surface is bounded by what a service serves, some ten thousand endpoints at most.
    """
    operation = F.struct(
        F.col("handler").alias("operationId"), F.col("file").alias("x-file"), F.col("line").alias("x-line"),
        F.transform("auth_chain", lambda a: F.create_map(a, F.array().cast("array<string>"))).alias("security"),
        F.struct(F.struct(F.lit("OK").alias("description")).alias("200")).alias("responses"),
    )
    last = surface.groupBy("path", F.lower("method").alias("method")).agg(F.max_by(F.to_json(operation), F.struct("handler", "file", "line")).alias("op"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    members = lambda k, v: F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, v))), lambda e: F.concat(quoted(e[k]), F.lit(":"), e[v])), ","), F.lit("}"))
    by_path = last.groupBy("path").agg(members("method", "op").alias("ops"))
    head = F.lit(f'{{"openapi":"3.0.0","info":{{"title":"{title}","version":"{version}"}},"paths":')
    return by_path.agg(F.concat(head, members("path", "ops"), F.lit("}")).alias("document"))


# --- security -------------------------------------------------------------------------------------------------------

#: fixed values: severities in order, and concepts of endpoints
SEVERITIES = ("low", "medium", "high", "critical")
ENDPOINT_CONCEPTS = ("http-handler", "api-handler", "endpoint")


@dataclass(frozen=True)
class TaintRule:
    category: str
    severity: str
    sources: tuple[str, ...]
    sinks: tuple[str, ...]
    sanitizers: tuple[str, ...] = field(default=())


#: fixed values: what tainted input, dangerous calls and cleaning calls look like
TAINT_RULES = (
    TaintRule("sql-injection", "critical", ("req.Body", "r.URL", "r.Form", "c.Param", "c.Query", "input", "request"), ("db.Query", "db.Exec", "db.Raw", "sql.Query", "surrealdb.Query"), ("Prepare", "Parameterize", "Escape")),
    TaintRule("command-injection", "critical", ("req.Body", "input", "os.Args", "flag."), ("exec.Command", "os.StartProcess", "syscall.Exec"), ("shellescape", "shlex.Quote")),
    TaintRule("xss", "high", ("req.Body", "r.URL", "input", "request"), ("fmt.Fprintf", "w.Write", "template.HTML", "ResponseWriter.Write"), ("html.EscapeString", "template.HTMLEscapeString", "sanitize")),
    TaintRule("path-traversal", "high", ("req.Body", "r.URL", "c.Param", "filepath."), ("os.Open", "os.ReadFile", "ioutil.ReadFile", "filepath.Join"), ("filepath.Clean", "path.Clean")),
)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def at_least(issues: DataFrame, severity: str) -> DataFrame:
    """Issues of a severity or above."""
    return issues.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity) + 1)


def auth_gaps(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(node_id, qualified, category, severity): endpoints with callers none of which looks like authentication.

    Endpoints are functions with an endpoint concept, the first ``limit`` by id.
    """
    handlers = nodes.where((F.col("label") == "function") & F.arrays_overlap("concepts", F.array(*map(F.lit, ENDPOINT_CONCEPTS)))).orderBy("node_id").limit(limit).select("node_id", "qualified")
    callers = edges.where(F.col("label") == "calls").select(F.col("to_id").alias("node_id"), F.col("from_id"))
    named = nodes.select(F.col("node_id").alias("from_id"), F.lower("qualified").alias("caller"))
    seen = callers.join(F.broadcast(handlers), "node_id").join(named, "from_id").groupBy("node_id", "qualified").agg(F.max(F.col("caller").rlike("auth|middleware|jwt").cast("int")).alias("guarded"))
    return seen.where("guarded = 0").select("node_id", "qualified", F.lit("missing-auth").alias("category"), F.lit("medium").alias("severity"))


def taint_findings(nodes: DataFrame, edges: DataFrame, rules: tuple[TaintRule, ...] = TAINT_RULES, max_depth: int = 5) -> DataFrame:
    """(node_id, sink, hop, category, severity): sinks that data from a source reaches without passing a sanitizer.

    A source is an edge whose argument expression holds a source pattern; taint starts at its target.  Nodes whose
    name holds a sanitizer pattern are cut out of the graph.
    """
    flow = edges.where(F.col("label") == "data_flow")
    named = nodes.select("node_id", F.coalesce("qualified", "node_id").alias("q"))
    contains = lambda c, words: c.rlike("|".join(w.replace(".", r"\.") for w in words)) if words else F.lit(False)
    out = None
    for rule in rules:
        cut = named.where(contains(F.col("q"), rule.sanitizers)).select("node_id")
        open_ = flow.join(cut.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti").join(cut.withColumnRenamed("node_id", "from_id"), "from_id", "left_anti")
        begin = open_.where(contains(F.coalesce(F.try_element_at("props", F.lit("arg_expr")), F.lit("")), rule.sources)).select(F.col("to_id").alias("node_id")).distinct()
        hops = traverse.min_hop(traverse.traverse(begin.select(F.lit("*").alias("seed_id"), "node_id"), open_, ["data_flow"], "forward", max_depth)).select("node_id", "hop")
        reached = hops.unionByName(begin.withColumn("hop", F.lit(0))).groupBy("node_id").agg(F.min("hop").alias("hop"))
        hit = reached.join(named, "node_id").where(contains(F.col("q"), rule.sinks)).select("node_id", F.col("q").alias("sink"), "hop", F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"))
        out = hit if out is None else out.unionByName(hit)
    return out


# --- field flow -------------------------------------------------------------------------------------------------


def field_flow_hops(seeds: DataFrame, edges: DataFrame, field_path: str | None = None, max_depth: int = 10) -> DataFrame:
    """Hops of every field's chain, a row each: (field_path, depth, from_id, to_id, label, mutation_type, mutates).

    Walks data_flow, reads and writes; an edge without a field is of ``_default``, which any filter lets pass.
    """
    rows = traverse.field_flow_edges(seeds, edges, field_path, max_depth, ("data_flow", "reads", "writes"))
    mutates = F.coalesce(F.col("mutation_type") != "none", F.lit(False))
    return rows.select(F.coalesce("field_path", F.lit("_default")).alias("field_path"), "depth", "from_id", "to_id", "label", "mutation_type", mutates.alias("mutates"))


def field_flow_chains(seeds: DataFrame, edges: DataFrame, field_path: str | None = None, max_depth: int = 10, only_mutated: bool = False) -> DataFrame:
    """One row for each field: (field_path, n_hops, n_mutations, depth, taint_node, taint_depth); its hops are rows of
    ``field_flow_hops``.  The taint point is the first mutating hop."""
    hops = field_flow_hops(seeds, edges, field_path, max_depth)
    out = hops.groupBy("field_path").agg(
        F.count("*").alias("n_hops"), F.count_if("mutates").alias("n_mutations"), F.max("depth").alias("depth"), F.min(F.when(F.col("mutates"), F.struct("depth", "to_id"))).alias("taint"),
    ).select("field_path", "n_hops", "n_mutations", "depth", F.col("taint.to_id").alias("taint_node"), F.col("taint.depth").alias("taint_depth"))
    return out.where("n_mutations > 0") if only_mutated else out


def data_flow_context(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, context): a text of a node's sources, sinks, reads and writes, in that order."""
    near = traverse.neighbours(edges, nodes, of)

    def section(name: str, column: str) -> Column:
        items = F.transform(column, lambda x: F.concat(x["other_qualified"], F.coalesce(F.concat(F.lit(" ("), x["detail"], F.lit(")")), F.lit(""))))
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, ", "), F.lit("\n")))

    parts = [section(n, c) for n, c in (("Data flows from", "sources"), ("Data flows to", "sinks"), ("Reads", "reads"), ("Writes", "writes"))]
    return near.select("node_id", F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).alias("context"))


# --- history ------------------------------------------------------------------------------------------------------


def index_commits(versions: DataFrame) -> DataFrame:
    """(key, hash, ts, change) of node versions (key, hash, ts, content_hash, status): ``added`` where a node first
    shows or its file was added, ``modified`` where its content changed; deletions and equal content give nothing."""
    live = versions.where(F.col("status") != "deleted")
    before = F.lag("content_hash").over(W.partitionBy("key").orderBy("ts", "hash"))
    first = F.row_number().over(W.partitionBy("key").orderBy("ts", "hash")) == 1
    kind = F.when(first | (F.col("status") == "added"), "added").when(~F.col("content_hash").eqNullSafe(before), "modified")
    return live.select("key", "hash", "ts", kind.alias("change")).where("change is not null")


def node_history(changes: DataFrame) -> DataFrame:
    """(key, introduced_commit, introduced_at, last_modified_commit, last_modified_at, n_changes) of changes."""
    return changes.groupBy("key").agg(
        F.min_by("hash", F.struct("ts", "hash")).alias("introduced_commit"), F.min("ts").alias("introduced_at"),
        F.max_by("hash", F.struct("ts", "hash")).alias("last_modified_commit"), F.max("ts").alias("last_modified_at"), F.count("*").alias("n_changes"),
    )


def temporal_range(nodes: DataFrame, since, until, limit: int = 100) -> DataFrame:
    """Nodes changed in [since, until] with ``change`` (added if never modified since), at most ``limit`` a label, by time."""
    hit = nodes.where((F.col("last_modified_at") >= since) & (F.col("last_modified_at") <= until))
    kind = F.when(F.col("introduced_commit") == F.col("last_modified_commit"), "added").otherwise("modified")
    ranked = hit.withColumns({"change": kind, "__n": F.row_number().over(W.partitionBy("label").orderBy("last_modified_at", "node_id"))})
    return ranked.where(F.col("__n") <= limit).drop("__n")


def edges_introduced(edges: DataFrame, commit: str, limit: int = 100) -> DataFrame:
    """Edges that a commit introduced, at most ``limit`` a label, by their ends."""
    hit = edges.where(F.col("introduced_commit") == commit)
    return hit.withColumn("__n", F.row_number().over(W.partitionBy("label").orderBy("from_id", "to_id"))).where(F.col("__n") <= limit).drop("__n")


def temporal_upsert(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` with introduced_* and last_modified_* of ``changes`` (node_id, hash, ts): the first stays, the last moves."""
    seen = changes.groupBy("node_id").agg(F.min(F.struct("ts", "hash")).alias("lo"), F.max(F.struct("ts", "hash")).alias("hi"))
    joined = nodes.join(seen, "node_id", "left")
    return joined.withColumns({
        "introduced_commit": F.coalesce("introduced_commit", "lo.hash"), "introduced_at": F.coalesce("introduced_at", "lo.ts"),
        "last_modified_commit": F.coalesce("hi.hash", "last_modified_commit"), "last_modified_at": F.coalesce("hi.ts", "last_modified_at"),
    }).select(*nodes.columns)


def suspect_scores(suspects: DataFrame, chains: DataFrame, mutations: DataFrame, as_of: Column) -> DataFrame:
    """(hash, score) of commits (hash, ts): 0.5, more the younger, 0.4 for each chain (introduced_commit,
    last_modified_commit of its taint node) of the commit and 0.2 for each mutation (last_modified_commit); 1 at most."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    fresh = F.when(days < 1, 0.3).when(days < 7, 0.2).when(days < 30, 0.1).otherwise(0.0)
    both = F.array_distinct(F.filter(F.array("introduced_commit", "last_modified_commit"), lambda c: c.isNotNull()))
    taints = chains.select(F.explode(both).alias("hash")).groupBy("hash").agg(F.count("*").alias("taints"))
    moved = mutations.where("last_modified_commit is not null").groupBy(F.col("last_modified_commit").alias("hash")).agg(F.count("*").alias("moved"))
    joined = suspects.join(taints, "hash", "left").join(moved, "hash", "left")
    score = 0.5 + fresh + 0.4 * F.coalesce("taints", F.lit(0)) + 0.2 * F.coalesce("moved", F.lit(0))
    return joined.select("hash", F.round(F.least(score, F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "hash")


def root_cause(located: DataFrame, edges: DataFrame, nodes: DataFrame, commits: DataFrame, as_of: Column, since=None, max_depth: int = 8, top: int = 5) -> DataFrame:
    """(hash, author, message, ts, score): commits suspected of a fault at ``located`` (node_id, best first by score).

    Fields that flow into the best ``top`` nodes are followed back; commits that touched what is found are scored.
    """
    best = located.orderBy(F.desc("score"), "node_id").limit(top).select("node_id")
    rows = traverse.field_flow_edges(best, edges, None, max_depth, direction="reverse").where("mutation_type is not null and mutation_type <> 'none'")
    about = nodes.select("node_id", "introduced_commit", "last_modified_commit")
    hops = rows.withColumn("field_path", F.coalesce("field_path", F.lit("_default"))).join(about.withColumnRenamed("node_id", "to_id"), "to_id")
    taint = hops.groupBy("field_path").agg(F.min_by(F.struct("introduced_commit", "last_modified_commit"), F.struct("depth", "to_id")).alias("t")).select("t.*")
    touched = best.join(about, "node_id").unionByName(hops.select(F.col("to_id").alias("node_id"), "introduced_commit", "last_modified_commit"))
    named = touched.select(F.explode(F.array("introduced_commit", "last_modified_commit")).alias("hash")).where("hash is not null").distinct()
    known = commits.join(named, "hash", "left_semi")
    if since is not None:
        known = known.where(F.col("ts") >= since)
    return known.join(suspect_scores(known.select("hash", "ts"), taint, hops, as_of), "hash").select("hash", "author", "message", "ts", "score").orderBy(F.desc("score"), "hash")
