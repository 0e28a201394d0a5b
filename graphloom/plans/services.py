"""Registered queries of the store, the linkers, analyses, memory, files and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import ids, paths, text, vectors
from graphloom.operators import analyze, derive, link, memory, search, store, sync, traverse
from graphloom.operators.extract import runner
from graphloom.plans import driver_graph as g
from graphloom.plans.catalogue import COSINE, _vector, query
from graphloom.plans.driver_graph import Tables
from graphloom.sources import files, gitlog
from graphloom.storage import cut, new_folder
from graphloom.streaming import changefeed


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


# --- the store --------------------------------------------------------------------------------------------------------


def _customers(t: Tables, name=None) -> DataFrame:
    return t.customer.select(_id("customer", "c_custkey").alias("node_id"), F.lit("customer").alias("label"), (F.col("c_name") if name is None else name).alias("name"), F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("repo_slug"), "c_custkey")


def _orders(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("calls").alias("label"), _id("customer", "o_custkey").alias("from_id"), _id("orders", "o_orderkey").alias("to_id"), F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("repo_slug"), "o_orderkey")


def _store(t: Tables) -> store.GraphStore:
    """Customers and their orders; a quarter of the customers are put again, a seventh deleted, urgent edges appended twice."""
    s = store.GraphStore(t.spark, new_folder(t.spark))
    s.put_batch(_customers(t), _orders(t))
    s.put_nodes(_customers(t, F.upper("c_mktsegment")).where("c_custkey % 4 = 0"))
    s.put_edges(_orders(t).where("o_orderkey % 5 = 0"))
    s.delete(_customers(t).where("c_custkey % 7 = 0"))
    return s


@query("store_nodes", "SELECT 'customer:' || c_custkey AS node_id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) ELSE c_name END AS name, 'r' || c_nationkey % 3 AS repo_slug FROM customer WHERE c_custkey % 7 <> 0", graph=False)
def _(t):
    return _store(t).nodes.select("node_id", "name", "repo_slug")


@query("store_edges", """SELECT 'customer:' || o_custkey AS from_id, 'orders:' || o_orderkey AS to_id, count(*) AS n FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 0) JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 7 <> 0 GROUP BY 1, 2""", graph=False)
def _(t):
    return _store(t).edges.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@query("store_change_log", """WITH c AS (SELECT c_custkey FROM customer), e AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'put' AS op, 'node' AS kind, (SELECT count(*) FROM c) + (SELECT count(*) FROM c WHERE c_custkey % 4 = 0) AS n UNION ALL SELECT 'delete', 'node', (SELECT count(*) FROM c WHERE c_custkey % 7 = 0)
UNION ALL SELECT 'put', 'edge', (SELECT count(*) FROM e) + (SELECT count(*) FROM e WHERE o_orderkey % 5 = 0) UNION ALL SELECT 'delete', 'edge', (SELECT count(*) FROM e WHERE o_custkey % 7 = 0)""", graph=False)
def _(t):
    return _store(t).log().groupBy("op", "kind").agg(F.count("*").alias("n"))


@query("store_delete_edges", "SELECT 'customer:' || o_custkey AS from_id, 'orders:' || o_orderkey AS to_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey <> 1", graph=False)
def _(t):
    s = store.GraphStore(t.spark, new_folder(t.spark))
    s.put_edges(_orders(t))
    for repo in s.edge_table.repos():
        s.delete_edges_of(repo, "customer:1")
    return s.edges.select("from_id", "to_id")


@query("store_repos", "SELECT n_name AS slug, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE 'p' || n_nationkey END AS path FROM nation WHERE n_regionkey <> 2", graph=False)
def _(t):
    s = store.GraphStore(t.spark, new_folder(t.spark))
    rows = t.nation.select(F.col("n_name").alias("slug"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("path"), "n_regionkey")
    s.put_repo(rows)
    s.put_repo(rows.where("n_regionkey = 1").withColumn("path", F.lit("moved")))
    for r in rows.where("n_regionkey = 2").select("slug").collect():  # five nations
        s.delete_repo(r.slug)
    return s.list_repos().select("slug", "path")


@query("reindexed_edges", """WITH e AS (SELECT 'customer:' || o_custkey AS from_id, 'orders:' || o_orderkey AS to_id, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT from_id, to_id FROM e WHERE k % 3 <> 0 UNION ALL SELECT from_id, 'new' FROM e WHERE k % 3 = 0""", graph=False)
def _(t):
    s = store.GraphStore(t.spark, new_folder(t.spark))
    s.put_edges(_orders(t))
    for repo in s.edge_table.repos():  # three repositories: of each the edges of a third of the orders are made anew
        kept = s.edge_table.read(repo)
        again = F.substring_index("to_id", ":", -1).cast("long") % 3 == 0
        s.replace_edges(repo, kept.where(~again).unionByName(kept.where(again).withColumn("to_id", F.lit("new"))))
    return s.edges.select("from_id", "to_id")


@query("point_lookup", " SELECT node_id, label, qualified, file_path FROM nodes WHERE node_id = 'part:7'")
def _(t):
    return g.nodes(t).where(F.col("node_id") == "part:7").select("node_id", "label", "qualified", "file_path")


@query("keep_generated", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'old' END AS summary FROM customer", graph=False)
def _(t):
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    made = lambda body, summary: t.customer.select(F.lit("r").alias("repo_slug"), key.alias("node_id"), body.alias("body"), none.alias("signature"), none.alias("docstring"), summary.alias("summary"))
    parsed = made(F.when(key % 2 == 0, "same").otherwise("changed"), F.when(key % 3 == 0, "new"))
    return store.keep_generated(parsed, made(F.lit("same"), F.lit("old")), ("summary",)).select("node_id", "summary")


@query("skeleton", "SELECT p_partkey AS node_id, p_name AS name FROM part", graph=False)
def _(t):
    return sync.skeleton(t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("body"), F.array("p_type").alias("concepts")))


@query("delta_dto", """, e AS (SELECT 'nation:' || n_nationkey AS id FROM nation) SELECT 'put' AS op, 'node' AS kind, node_id AS id, label, qualified AS name, start_line, CAST(NULL AS VARCHAR) AS to_id FROM nodes WHERE label = 'customer'
UNION ALL SELECT 'put', 'edge', from_id || '>defines>' || to_id, 'defines', NULL, -1, to_id FROM defines""")
def _(t):
    return changefeed.delta_rows(g.nodes(t).where("label = 'customer'"), g.defines(t)).select("op", "kind", "id", "label", "name", F.coalesce("start_line", F.lit(-1)).alias("start_line"), "to_id")


@query("closed_values", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant', 'system')", graph=False)
def _(t):
    return schema.require(t.conversations.where("role in ('user', 'assistant', 'system')").select("conv_id", "turn", "role"), "role")


@query("bundle_round_trip", " SELECT node_id, qualified, repo_slug FROM nodes WHERE label IN ('customer', 'supplier')")
def _(t):
    folder = new_folder(t.spark)
    rows = g.nodes(t).where("label in ('customer', 'supplier')").withColumn("body", F.lit("x"))
    sync.push(rows, g.defines(t), "r", folder, ["r"], "key")
    nodes, _, _ = sync.read_bundle(t.spark, folder, "key")
    return nodes.select("node_id", "qualified", "repo_slug")


@query("pull_merge", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN 'theirs' ELSE 'ours' END AS content_hash, CASE WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'local' END AS action FROM customer", graph=False)
def _(t):
    key = F.col("c_custkey")
    rows = lambda cond, says, day: t.customer.where(cond).select(F.lit("o/r").alias("repo_slug"), key.alias("node_id"), F.lit("x").alias("label"), F.lit(says).alias("content_hash"), F.lit(day).cast("date").alias("last_modified_at"))
    edges = _orders(t).select("label", "from_id", "to_id")
    folder = new_folder(t.spark)
    sync.push(rows(key % 2 == 0, "theirs", "2024-02-01"), edges, "o/r", folder, ["o/*"])
    merged, _, _ = sync.pull(rows(key >= 0, "ours", "2024-01-01"), edges, "o/r", folder, ["o/r"])
    return merged.select("node_id", "content_hash", "action")


# --- linkers ----------------------------------------------------------------------------------------------------------

OWNERS = """WITH fn AS (SELECT 'function:' || o_orderkey AS id, 'pkg' || o_custkey % 50 AS pkg, 'T' || o_orderkey % 40 AS cls, o_orderkey AS k FROM orders),
cls AS (SELECT DISTINCT 'pkg' || o_custkey % 50 AS pkg, 'T' || o_orderkey % 25 AS cls FROM orders) """


def _typed(t: Tables) -> DataFrame:
    k, pkg = F.col("o_orderkey"), F.concat(F.lit("pkg"), (F.col("o_custkey") % 50).cast("string"))
    of = lambda n: F.concat(F.lit("T"), (k % n).cast("string"))
    fn = t.orders.select(F.concat(F.lit("function:"), k.cast("string")).alias("node_id"), F.lit("function").alias("label"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.concat_ws(".", pkg, of(40), F.concat(F.lit("f"), k.cast("string"))).alias("qualified"), F.lit("x.go").alias("file_path"))
    cls = t.orders.select(F.concat_ws(".", pkg, of(25)).alias("qualified"), of(25).alias("name")).distinct()
    return fn.unionByName(cls.select(F.concat(F.lit("class:"), F.col("qualified")).alias("node_id"), F.lit("class").alias("label"), "name", "qualified", F.lit("x.go").alias("file_path")))


@query("link_field_access", OWNERS + """SELECT f.id AS from_id, coalesce('class:' || a.pkg || '.' || a.cls, 'class:' || b.pkg || '.' || b.cls, 't' || f.k % 30 || '.v') AS to_id, a.cls IS NOT NULL OR b.cls IS NOT NULL AS resolved
FROM fn f LEFT JOIN cls a ON a.pkg = f.pkg AND a.cls = f.cls LEFT JOIN cls b ON b.pkg = f.pkg AND b.cls = 'T' || f.k % 30""", graph=False)
def _(t):
    reads = t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, "reads").otherwise("writes").alias("label"), F.concat(F.lit("function:"), F.col("o_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 30).cast("string"), F.lit(".v")).alias("to_id"))
    return link.FieldAccessLinker().link(reads, _typed(t)).select("from_id", "to_id", "resolved")


def _targets(t: Tables, label: str) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    to = F.when(k % 3 == 0, F.concat(F.lit("orders."), F.col("o_orderstatus"), F.lit(".O"), key)).when(k % 3 == 1, F.concat(F.lit("orders:"), key)).otherwise(F.concat(F.lit("none"), key))
    return t.orders.select(F.lit(label).alias("label"), F.lit("file:x").alias("from_id"), to.alias("to_id"))


TARGETS = """, linked AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 2 THEN 'none' || o_orderkey ELSE 'orders:' || o_orderkey END AS to_id FROM orders) SELECT '{0}' AS label, to_id, k % 3 <> 2 AS resolved FROM linked"""


@query("link_routes", TARGETS.format("route"))
def _(t):
    return link.RouteLinker().link(_targets(t, "route"), g.nodes(t)).select("label", "to_id", "resolved")


@query("link_data_flow", TARGETS.format("data_flow"))
def _(t):
    return link.DataFlowLinker().link(_targets(t, "data_flow"), g.nodes(t)).select("label", "to_id", "resolved")


@query("call_sites", """WITH s AS (SELECT l_orderkey AS id, min('f' || l_orderkey || '.go:' || (l_linenumber + 10)) AS site FROM lineitem GROUP BY l_orderkey)
SELECT 'orders:' || o_orderkey AS node_id, site AS caller_site FROM orders LEFT JOIN s ON id = o_orderkey""", graph=False)
def _(t):
    site = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".go:"), (F.col("l_linenumber") + 10).cast("string"))
    edges = t.lineitem.select(_id("orders", "l_orderkey").alias("from_id"), site.alias("call_site"))
    return link.first_call_site(t.orders.select(_id("orders", "o_orderkey").alias("node_id")), edges).select("node_id", "caller_site")


@query("site_excerpts", "SELECT doc_id AS node_id, CASE WHEN text IS NOT NULL THEN array_to_string(string_split(text, chr(10))[1:4], chr(10)) END AS excerpt FROM documents", graph=False)
def _(t):
    hops = t.documents.select(F.col("doc_id").alias("node_id"), F.lit("x.go:20").alias("caller_site"))
    return link.site_excerpt(hops, t.documents.select(F.col("doc_id").alias("node_id"), F.col("text").alias("body"), F.lit(20).alias("start_line"))).select("node_id", "excerpt")


# --- analyses ---------------------------------------------------------------------------------------------------------


@query("trace_service", """, walk AS (SELECT node_id, 0 AS hop FROM nodes WHERE node_id = 'customer:1' UNION SELECT e.to_id, w.hop + 1 FROM walk w JOIN calls e ON e.from_id = w.node_id WHERE w.hop < 5),
hops AS (SELECT node_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY node_id HAVING min(hop) > 0), sites AS (SELECT from_id, min(from_id || ':1') AS site FROM calls GROUP BY from_id)
SELECT h.node_id, h.hop, n.qualified, s.site AS caller_site FROM hops h LEFT JOIN nodes n ON n.node_id = h.node_id LEFT JOIN sites s ON s.from_id = h.node_id""")
def _(t):
    seeds = g.nodes(t).where("node_id = 'customer:1'").select(F.lit("s").alias("seed_id"), "node_id")
    return analyze.trace(seeds, g.calls(t), g.nodes(t), sites=True).select("node_id", "hop", "qualified", "caller_site")


@query("traverse_defaults", """, walk AS (SELECT node_id, 0 AS hop FROM nodes WHERE label = 'region' UNION SELECT e.to_id, w.hop + 1 FROM walk w JOIN (SELECT * FROM defines UNION ALL SELECT * FROM calls) e ON e.from_id = w.node_id WHERE w.hop < 5),
hops AS (SELECT node_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY node_id HAVING min(hop) > 0) SELECT h.node_id, h.hop FROM hops h JOIN nodes n ON n.node_id = h.node_id AND n.label IN ('part', 'customer')""")
def _(t):
    nodes = g.nodes(t)
    seeds = nodes.where("label = 'region'").select(F.lit("*").alias("seed_id"), "node_id")
    return traverse.traverse(seeds, g.defines(t).unionByName(g.calls(t)), ["defines", "calls"], mode="mixed", nodes=nodes, target_labels=["part", "customer"], via=False).select("node_id", "hop")


@query("walk_parents", """, e AS (SELECT from_id, to_id FROM defines), h1 AS (SELECT to_id AS node_id, min(from_id) AS parent_id FROM e WHERE from_id LIKE 'region:%' GROUP BY to_id), h2 AS (SELECT e.to_id AS node_id, min(e.from_id) AS parent_id FROM e JOIN h1 ON h1.node_id = e.from_id GROUP BY e.to_id)
SELECT node_id, CAST(1 AS INTEGER) AS hop, parent_id, 'defines' AS label, parent_id || ':1' AS call_site FROM h1 UNION ALL SELECT node_id, 2, parent_id, 'defines', parent_id || ':1' FROM h2""")
def _(t):
    seeds = g.nodes(t).where("label = 'region'").select(F.lit("*").alias("seed_id"), "node_id")
    return traverse.traverse(seeds, g.defines(t), ["defines"], max_depth=4).select("node_id", "hop", "parent_id", "label", "call_site")


@query("hops_by_name", """SELECT p_brand AS qualified, min(p_size) AS hop, count(*) - count(*) + 1 AS n FROM part GROUP BY p_brand""", graph=False)
def _(t):
    hops = t.part.select(F.lit("s").alias("seed_id"), F.col("p_partkey").cast("string").alias("node_id"), F.col("p_size").alias("hop"))
    named = traverse.first_by_qualified(hops, t.part.select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_brand").alias("qualified")))
    return named.groupBy("qualified").agg(F.min("hop").alias("hop"), F.count("*").alias("n"))


@query("data_flow_context", """, r AS (SELECT n.qualified, d.to_id, d.from_id FROM defines d JOIN nodes n ON n.node_id = d.to_id), k AS (SELECT from_id, qualified, row_number() OVER (PARTITION BY from_id ORDER BY qualified, to_id) AS rn FROM r),
sinks AS (SELECT from_id AS id, string_agg(qualified || ' (v)', ', ' ORDER BY rn) AS s FROM k WHERE rn <= 20 GROUP BY from_id)
SELECT 'nation:' || n_nationkey AS node_id, 'Data flows from: ' || r_name || ' (a)' || chr(10) || CASE WHEN s IS NULL THEN '' ELSE 'Data flows to: ' || s || chr(10) END AS context FROM place LEFT JOIN sinks ON id = 'nation:' || n_nationkey""")
def _(t):
    flow = g.defines(t).select(F.lit("data_flow").alias("label"), "from_id", "to_id", F.create_map(F.lit("field_path"), F.lit("v"), F.lit("arg_expr"), F.lit("a")).alias("props"))
    nodes = g.nodes(t)
    return analyze.data_flow_context(flow, nodes, nodes.where("label = 'nation'"))


@query("resolve_interface", """, impl AS (SELECT DISTINCT 'part:' || p_partkey AS node_id FROM part WHERE p_size <= 20), users AS (SELECT from_id AS a, to_id AS b FROM calls),
one AS (SELECT DISTINCT a AS node_id FROM users JOIN impl ON b = node_id), two AS (SELECT DISTINCT a AS node_id FROM users JOIN one ON b = node_id),
site AS (SELECT node_id FROM one UNION SELECT node_id FROM two)
SELECT i.node_id, qualified, 'implementation' AS role FROM impl i JOIN nodes n ON n.node_id = i.node_id UNION ALL SELECT s.node_id, qualified, 'binding' FROM site s JOIN nodes n ON n.node_id = s.node_id WHERE s.node_id NOT IN (SELECT node_id FROM impl)""")
def _(t):
    made = t.part.where("p_size <= 20").select(F.lit("implements").alias("label"), _id("part", "p_partkey").alias("from_id"), F.lit("iface").alias("to_id"), F.lit(None).cast("string").alias("call_site"))
    return analyze.resolve_interface(t.spark.createDataFrame([("iface",)], "node_id string"), made.unionByName(g.calls(t)), g.nodes(t), True)


@query("api_document", """WITH r AS (SELECT 'GET' AS method, '/b' || p_size % 5 AS path, 'h' || p_partkey AS handler, 'f.go' AS file, p_partkey AS line FROM part),
l AS (SELECT path, lower(method) AS method, arg_max(handler, lpad(handler, 20, ' ')) AS any_handler, max(handler) AS handler FROM r GROUP BY 1, 2) SELECT path, handler, length(path) > 0 AS ok FROM l""", graph=False)
def _(t):
    surface = t.part.select(F.lit("GET").alias("method"), F.concat(F.lit("/b"), (F.col("p_size") % 5).cast("string")).alias("path"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("handler"), F.lit("f.go").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.array(F.lit("jwt")).alias("auth_chain"))
    kinds = "struct<openapi:string,paths:map<string,map<string,struct<operationId:string,`x-file`:string>>>>"
    doc = analyze.openapi(surface).select(F.from_json("document", kinds).alias("d"))
    return doc.select(F.explode("d.paths").alias("path", "ops")).select("path", F.col("ops")["get"]["operationId"].alias("handler"), (F.length("path") > 0).alias("ok"))


@query("temporal_upsert", """WITH c AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi, arg_min('c' || event_id, ts) AS a, arg_max('c' || event_id, ts) AS b FROM events GROUP BY user_id)
SELECT c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE a END AS introduced_commit, coalesce(b, 'last') AS last_modified_commit FROM customer LEFT JOIN c ON user_id = c_custkey""", graph=False)
def _(t):
    at = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    nodes = t.customer.select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 2 == 0, "first").alias("introduced_commit"), at.alias("introduced_at"), F.lit("last").alias("last_modified_commit"), at.alias("last_modified_at"))
    changes = t.events.select(F.col("user_id").alias("node_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("hash"), "ts")
    return analyze.temporal_upsert(nodes, changes).select("node_id", "introduced_commit", "last_modified_commit")


@query("root_cause", """, best AS (SELECT 'user:' || c_custkey AS node_id FROM customer ORDER BY round(c_acctbal, 2) DESC, node_id LIMIT 5), f AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY from_id, field_path, mutation_type NULLS FIRST) AS rn FROM flows),
walk AS (SELECT node_id, 0 AS d FROM best UNION SELECT f.from_id, w.d + 1 FROM walk w JOIN f ON f.to_id = w.node_id AND rn <= 50 WHERE w.d < 8), near AS (SELECT node_id, min(d) AS d FROM walk GROUP BY node_id),
hop AS (SELECT near.d + 1 AS depth, f.to_id AS src, f.from_id AS dst, coalesce(field_path, '_default') AS field_path FROM near JOIN f ON f.to_id = near.node_id AND rn <= 50 WHERE near.d < 8 AND mutation_type IS NOT NULL),
about AS (SELECT 'user:' || c_custkey AS node_id, 'c' || c_custkey % 40 AS a, 'c' || c_custkey % 60 AS b FROM customer),
hops AS (SELECT hop.*, a, b FROM hop JOIN about ON node_id = dst), taint AS (SELECT field_path, arg_min(struct_pack(a := a, b := b), struct_pack(depth := depth, dst := dst)) AS t FROM hops GROUP BY field_path),
named AS (SELECT a AS hash FROM best JOIN about USING (node_id) UNION SELECT b FROM best JOIN about USING (node_id) UNION SELECT a FROM hops UNION SELECT b FROM hops),
ends AS (SELECT t.a AS hash FROM taint UNION ALL SELECT t.b FROM taint WHERE t.b <> t.a), tc AS (SELECT hash, count(*) AS n FROM ends GROUP BY hash), mc AS (SELECT b AS hash, count(*) AS n FROM hops GROUP BY b)
SELECT hash, round(least(1.0, 0.5 + 0.1 + 0.4 * coalesce(tc.n, 0) + 0.2 * coalesce(mc.n, 0)), 6) AS score FROM named LEFT JOIN tc USING (hash) LEFT JOIN mc USING (hash)""")
def _(t):
    key, name = F.col("c_custkey"), lambda n: F.concat(F.lit("c"), (F.col("c_custkey") % n).cast("string"))
    nodes = t.customer.select(_id("user", "c_custkey").alias("node_id"), name(40).alias("introduced_commit"), name(60).alias("last_modified_commit"))
    located = t.customer.select(_id("user", "c_custkey").alias("node_id"), F.round("c_acctbal", 2).alias("score"))
    commits = t.spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("hash"), F.lit("a").alias("author"), F.lit("m").alias("message"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("ts"))
    found = analyze.root_cause(located, g.flows(t), nodes, commits, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return found.select("hash", "score")


@query("counted_neighbours", """, c AS (SELECT 'supplier:' || l_suppkey AS node_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT s.node_id, coalesce(n, 0) AS method_count FROM (SELECT 'supplier:' || s_suppkey AS node_id FROM supplier) s LEFT JOIN c USING (node_id)""")
def _(t):
    kind = F.when(F.col("label") == "supplier", "class").when(F.col("label") == "part", "function").otherwise(F.col("label"))
    edges = t.lineitem.select("l_suppkey", "l_partkey").distinct().select(F.lit("defines").alias("label"), _id("supplier", "l_suppkey").alias("from_id"), _id("part", "l_partkey").alias("to_id"))
    return derive.method_count(g.nodes(t).withColumn("label", kind), edges)


@query("class_depths", """SELECT 'nation:' || n_nationkey AS node_id, CAST(CASE WHEN n_regionkey < 3 THEN 1 ELSE 0 END AS BIGINT) AS depth FROM nation UNION ALL SELECT 'region:' || r_regionkey, 0 FROM region""", graph=False)
def _(t):
    nodes = t.nation.select(_id("nation", "n_nationkey").alias("node_id")).union(t.region.select(_id("region", "r_regionkey"))).withColumn("label", F.lit("class"))
    edges = t.nation.where("n_regionkey < 3").select(F.lit("inherits").alias("label"), _id("nation", "n_nationkey").alias("from_id"), _id("region", "n_regionkey").alias("to_id"))
    return derive.class_depth(nodes, edges)


@query("importing_files", "SELECT 'nation:' || n_nationkey AS node_id, count(c_custkey) AS file_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", graph=False)
def _(t):
    nodes = t.nation.select(_id("nation", "n_nationkey").alias("node_id"), F.lit("module").alias("label")).unionByName(t.customer.select(_id("customer", "c_custkey").alias("node_id"), F.lit("file").alias("label")))
    return derive.file_count(nodes, t.customer.select(F.lit("imports").alias("label"), _id("customer", "c_custkey").alias("from_id"), _id("nation", "c_nationkey").alias("to_id")))


# --- search -----------------------------------------------------------------------------------------------------------


@query("best_by_node", "SELECT c_nationkey AS node_id, max(c_acctbal) AS score FROM customer GROUP BY 1", graph=False)
def _(t):
    return search.best_by_node(t.customer.select(F.col("c_nationkey").alias("node_id"), F.col("c_acctbal").alias("score")))


@query("hybrid_fused_stage", f"""WITH vs AS (SELECT vec_id AS id, score FROM (SELECT e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score >= 0.2 ORDER BY score DESC, 'n:' || vec_id LIMIT 20)
SELECT 'n:' || id AS node_id, score FROM vs""", graph=False)
def _(t):
    nodes = t.embeddings.select(_id("n", "vec_id").alias("node_id"), F.lit("function").alias("label"), F.lit("x").alias("file_path"), F.array().cast("array<string>").alias("concepts"), "embedding", F.lit("none").alias("text"))
    none = t.spark.createDataFrame([], "label string, from_id string, to_id string")
    stages = dict(search.hybrid_stages(nodes, none, derive.degrees(nodes, none).select("node_id", "centrality"), "quest", _vector(t), 10, 0.2, fields={"text": text.word_tokens(F.col("text"))}))
    return stages["vector_hit"]


@query("embed_apply", "SELECT doc_id AS node_id, CAST(length(text) AS DOUBLE) AS first, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS second FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1", graph=False)
def _(t):
    nodes = t.documents.where("text is not null").select(F.col("doc_id").alias("node_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    made = search.embed_missing(nodes, F.col("text"), lambda texts: [[float(len(x)), float(x.count("a"))] for x in texts])
    return made.select("node_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("summarise_apply", "SELECT doc_id AS node_id, 'about ' || length(text) AS summary, source AS concept FROM documents WHERE trim(text, chr(32)) <> '' AND n_chars >= 50 AND length(text) > 0", graph=False)
def _(t):
    nodes = t.documents.select(F.col("doc_id").alias("node_id"), F.lit("function").alias("label"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("docstring"), F.col("text").alias("body"), F.lit("do").alias("name"), F.lit(0).alias("start_line"), F.col("n_chars").alias("end_line"), "source")
    said = search.summarise_missing(nodes, lambda texts: [(f"about {len(x)}", [str(len(x))]) for x in texts])
    return said.join(nodes.select("node_id", "source"), "node_id").select("node_id", "summary", F.col("source").alias("concept"))


@query("fit_vectors", """SELECT vec_id, CAST(8 AS INTEGER) AS dim, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * x)) / list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * x)), 6) AS length FROM embeddings""", graph=False)
def _(t):
    v = vectors.fit(F.col("embedding"), 8)
    return t.embeddings.select("vec_id", F.size(v).alias("dim"), F.round(vectors.norm(v), 6).alias("length"))


@query("vectors_of_dim", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN len(embedding) ELSE -1 END AS dim FROM embeddings", graph=False)
def _(t):
    size = F.size("embedding")
    cut_ = F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3))
    dim = t.embeddings.select(size.alias("n")).first()
    v = vectors.of_dim(cut_, dim.n if dim else 0)
    return t.embeddings.select("vec_id", F.when(v.isNotNull(), F.size(v)).otherwise(-1).cast("long").alias("dim"))


# --- memory -----------------------------------------------------------------------------------------------------------


def _findings(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    score = lambda n: (k % n) / F.lit(float(n - 1))
    return t.documents.select(k.alias("entry"), F.lit("g").alias("session"), F.concat(F.lit("Entry"), k.cast("string"), F.lit(" about"), (k % 50).cast("string"), F.when(k % 2 == 0, " quality").otherwise(" nothing")).alias("content"),
                              F.when(k % 3 == 0, "search:x").otherwise("deep_dive").alias("source"), score(5).alias("relevance"), score(7).alias("confidence"), score(11).alias("novelty"), score(13).alias("actionability"))


SCORED = """WITH s AS (SELECT doc_id AS entry, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) / 4.0 ELSE least((doc_id % 5) / 4.0, 0.5) END AS rel, least((doc_id % 7) / 6.0, CASE WHEN doc_id % 3 = 0 THEN 0.7 ELSE 0.95 END) AS con, (doc_id % 11) / 10.0 AS nov, (doc_id % 13) / 12.0 AS act FROM documents),
p AS (SELECT *, round(0.3 * rel + 0.3 * con + 0.2 * nov + 0.2 * act, 6) AS priority FROM s) """


@query("validated_evidence", SCORED + "SELECT entry, round(rel, 6) AS relevance, round(con, 6) AS confidence, priority FROM p", graph=False)
def _(t):
    return memory.validate(_findings(t), "the quality", ["session"]).select("entry", F.round("relevance", 6).alias("relevance"), F.round("confidence", 6).alias("confidence"), "priority")


@query("top_evidence", SCORED + "SELECT entry, priority FROM p WHERE priority >= 0.4 ORDER BY priority DESC, entry LIMIT 10", graph=False)
def _(t):
    return memory.top_evidence(memory.validate(_findings(t), "the quality", ["session"]), 10, 0.4).select("entry", "priority")


@query("persistable", SCORED + """SELECT 'finding' AS kind, 'Entry' || entry || ' about' || entry % 50 || CASE WHEN entry % 2 = 0 THEN ' quality' ELSE ' nothing' END AS content FROM (SELECT * FROM p WHERE priority >= 0.4 ORDER BY priority DESC, entry LIMIT 10)
UNION ALL SELECT 'hypothesis', 'confirmed: ' || n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'strategy', r_name FROM region""", graph=False)
def _(t):
    claims = t.nation.select(F.when(F.col("n_regionkey") == 0, "confirmed").otherwise("open").alias("status"), F.col("n_name").alias("content"))
    return memory.persistable(memory.validate(_findings(t), "the quality", ["session"]), claims, t.region.select(F.col("r_name").alias("content")))


@query("redundant_entries", "SELECT n_nationkey AS entry FROM nation WHERE n_regionkey IN (0, 2)", graph=False)
def _(t):
    words = F.concat(F.lit("alpha beta gamma delta key"), F.col("n_regionkey").cast("string"))
    known = t.region.where("r_regionkey in (0, 2)").select(F.concat(F.lit("alpha beta gamma delta key"), F.col("r_regionkey").cast("string")).alias("content"))
    return memory.is_redundant(t.nation.select(F.col("n_nationkey").alias("entry"), words.alias("content")), known).select("entry")


@query("tried_actions", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1", graph=False)
def _(t):
    args = F.concat(F.lit("find callers of handler n"), F.repeat((F.col("user_id") % 3).cast("string"), 3), F.when(F.col("user_id") % 3 == 1, "").otherwise(" else where now"))
    return memory.already_tried(t.events.select("event_id", F.col("event_type").alias("tool"), args.alias("args")), "click", "find callers of handler n111").select("event_id")


@query("valid_messages", "SELECT conv_id AS session_id, turn AS created_at, role FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(text) <> ''", graph=False)
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))
    return memory.valid_messages(rows).select("session_id", "created_at", "role")


@query("memory_store_sessions", "SELECT conv_id AS session_id, max(turn) AS last_turn, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(text) <> '' AND conv_id <> 1 GROUP BY conv_id", graph=False)
def _(t):
    m = memory.MemoryStore(t.spark, new_folder(t.spark))
    session, at = F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds("turn").alias("created_at")
    m.put_sessions(t.conversations.select(session, F.lit("r").alias("repo_slug")).distinct())
    m.add_messages(t.conversations.where("role in ('user', 'assistant', 'system')").select(session, F.concat_ws("/", "conv_id", "turn", "role").alias("message_id"), "role", F.col("text").alias("content"), at))
    m.delete_session("1")
    rows = memory.valid_messages(m.message_table.read()).join(m.sessions().select("session_id"), "session_id", "left_semi")
    kinds = dict(t.conversations.dtypes)
    return rows.groupBy(F.col("session_id").cast(kinds["conv_id"]).alias("session_id")).agg(F.max(F.unix_seconds("created_at")).cast(kinds["turn"]).alias("last_turn"), F.count("*").alias("n"))


@query("recalled_memories", f"SELECT 'm' || vec_id AS memory_id, score FROM (SELECT e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY score DESC, memory_id LIMIT 5", graph=False)
def _(t):
    m = memory.MemoryStore(t.spark, new_folder(t.spark))
    m.remember(t.embeddings.select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("memory_id"), F.lit("persistent").alias("tier"), F.lit("r").alias("repo_slug"), F.lit("c").alias("content"), F.col("embedding").cast("array<float>").alias("embedding")))
    return m.recall(_vector(t), 5).select("memory_id", "score")


# --- files, git, small rules ------------------------------------------------------------------------------------------


def _tree(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.when(k % 6 == 0, "vendor/").when(k % 6 == 1, "src/").when(k % 6 == 2, "gen/").when(k % 6 == 3, "src/node_modules/").otherwise("lib/")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 0, ".go").when(k % 4 == 1, ".py").when(k % 4 == 2, "_test.ts").otherwise(".txt"))
    return t.part.select(F.concat(folder, name).alias("path"), (F.col("p_size") * 1024).cast("long").alias("size"), F.encode("p_name", "UTF-8").alias("content"))


@query("walk_filters", """WITH f AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/' WHEN 2 THEN 'gen/' WHEN 3 THEN 'src/node_modules/' ELSE 'lib/' END AS d, 'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '_test.ts' ELSE '.txt' END AS n, p_size, CASE p_partkey % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' END AS language FROM part)
SELECT d || n AS path, language FROM f WHERE d NOT IN ('vendor/', 'src/node_modules/', 'gen/') AND p_size <= 40 AND language IN ('go', 'python', 'typescript') AND NOT ends_with(n, '_test.ts')""", graph=False)
def _(t):
    found = files.accept(_tree(t), ["go", "python", "typescript"], ["*_test.ts"], paths.ignore_patterns("# made\ngen/\n!kept\n"), 40)
    return found.select("path", "language")


@query("file_nodes", """SELECT 'file:f' || p_partkey || '⋅go' AS node_id, 'f' || p_partkey || '.go' AS file_path, sha256(p_name) AS content_hash, CAST(1 AS INTEGER) AS end_line FROM part""", graph=False)
def _(t):
    rows = t.part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.encode("p_name", "UTF-8").alias("content"))
    return files.file_nodes(rows, "r").select("node_id", "file_path", "content_hash", "end_line")


@query("go_modules", "SELECT DISTINCT 'module:ex⋅com⋅b' || p_size AS node_id, 'ex.com/b' || p_size AS qualified, 'v1.' || p_size || '.0' AS docstring FROM part UNION SELECT 'module:ex⋅com⋅own', 'ex.com/own', NULL", graph=False)
def _(t):
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit("\tex.com/b"), size, F.lit(" v1."), size, F.lit(".0 // indirect\n"))
    mods = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/go.mod")).alias("path"), F.encode(F.concat(F.lit("module ex.com/own\n\nrequire (\n"), line, F.lit(")\n")), "UTF-8").alias("content"))
    return files.go_mod_nodes(mods, "r").select("node_id", "qualified", "docstring")


@query("name_status", "SELECT CASE WHEN p_partkey % 4 = 1 THEN 'new' ELSE 'old' END || p_partkey AS path, CASE WHEN p_partkey % 4 = 1 THEN 'old' || p_partkey END AS old_path, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'renamed' WHEN 2 THEN 'deleted' ELSE 'modified' END AS status FROM part", graph=False)
def _(t):
    k, old, new = F.col("p_partkey"), F.concat(F.lit("old"), F.col("p_partkey").cast("string")), F.concat(F.lit("new"), F.col("p_partkey").cast("string"))
    line = F.when(k % 4 == 0, F.concat_ws("\t", F.lit("A"), old)).when(k % 4 == 1, F.concat_ws("\t", F.lit("R090"), old, new)).when(k % 4 == 2, F.concat_ws("\t", F.lit("D"), old)).otherwise(F.concat_ws("\t", F.lit("M"), old))
    return gitlog.parse_name_status(t.part.select(line.alias("value")))


@query("attached_patches", "SELECT 'f' || p_partkey || '.go' AS path, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'diff --git a/f' || p_partkey || '.go b/f' || p_partkey || '.go' || chr(10) || '+' || p_name || chr(10) END AS patch FROM part", graph=False)
def _(t):
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".go"))
    whole = t.part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n+"), F.col("p_name"), F.lit("\n")).alias("value"))
    return gitlog.attach_patches(t.part.select(name.alias("path")), gitlog.split_patches(whole))


@query("history_language", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN '' ELSE 'python' END AS language FROM part", graph=False)
def _(t):
    k = F.col("p_partkey")
    path = F.concat(F.lit("d/f"), F.when(k % 3 == 0, ".go").when(k % 3 == 1, ".PY").otherwise(".py"))
    return t.part.select("p_partkey", paths.language_in_history(path).alias("language"))


@query("name_rules", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS capital, p_name AS bare, 'part' AS kind, 'x:' || p_partkey AS key, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS n_lines FROM part", graph=False)
def _(t):
    kind, key = ids.split_id(F.concat(F.lit("part:x:"), F.col("p_partkey").cast("string")))
    return t.part.select("p_partkey", ids.capitalised(F.col("p_name")).alias("capital"), ids.trim_quotes(F.concat(F.lit("\"'"), F.col("p_name"), F.lit("`"))).alias("bare"), kind.alias("kind"), key.alias("key"), text.count_lines(F.replace("p_name", F.lit(" "), F.lit("\n"))).cast("long").alias("n_lines"))


@query("absent_as_null", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM pages", graph=False)
def _(t):
    return schema.absent_as_null(t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("url")))


# --- streams ----------------------------------------------------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.events.schema)
    return t.spark.readStream.schema(ddl).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("stream_hours", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def _(t):
    out, events = new_folder(t.spark), _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = changefeed.tumbling(events, "1 hour", ["event_type"], watermark="1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    kind = windows.schema.simpleString()
    run = windows.writeStream.outputMode("complete").option("checkpointLocation", new_folder(t.spark)).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    return t.spark.read.schema(kind[len("struct<") : -1].replace(":", " ")).parquet(out)


@query("stream_to_graph", "SELECT kind, id, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'node' ELSE 'edge' END AS kind, user_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') GROUP BY kind, id", graph=False)
def _(t):
    out, log = new_folder(t.spark), new_folder(t.spark)
    kind = F.when(F.col("event_id") % 2 == 0, "node").otherwise("edge")
    t.events.select(kind.alias("kind"), F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(log)
    id_kind = t.events.schema["user_id"].dataType.simpleString()
    changes = changefeed.read_changes(t.spark, log, f"kind string, id {id_kind}, ts timestamp", since=F.lit("2024-01-10 00:00:00").cast("timestamp"))
    save = lambda batch: batch.select("kind", "id").write.mode("append").parquet(out)
    changefeed.write_graph(changes, save, save, new_folder(t.spark)).awaitTermination()
    return t.spark.read.schema(f"kind string, id {id_kind}").parquet(out).groupBy("kind", "id").agg(F.count("*").alias("n"))


@query("latest_changes", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id", graph=False)
def _(t):
    return changefeed.latest_by_key(t.events.select("user_id", "ts", "event_id"), ["user_id"]).select("user_id", "ts")


@query("live_registry", "SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE", graph=False)
def _(t):
    return changefeed.live_entries(t.events.select(F.col("user_id").alias("key"), "ts"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("stage_states", """WITH m AS (SELECT user_id, event_type AS stage, list(CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'running' END ORDER BY ts, event_id) AS log FROM events GROUP BY user_id, event_type),
f AS (SELECT *, list_reduce(list_prepend('pending 0', log), lambda s, x: CASE
  WHEN split_part(s, ' ', 1) = 'pending' AND x IN ('running', 'skipped') OR split_part(s, ' ', 1) = 'running' AND x IN ('completed', 'failed') THEN x || ' ' || split_part(s, ' ', 2)
  ELSE split_part(s, ' ', 1) || ' ' || (CAST(split_part(s, ' ', 2) AS INT) + 1) END) AS last FROM m)
SELECT user_id, stage, split_part(last, ' ', 1) AS state, CAST(len(log) AS BIGINT) AS n_moves, CAST(split_part(last, ' ', 2) AS BIGINT) AS n_refused FROM f""", graph=False)
def _(t):
    """Every user's event types as stages, their events as moves: states after all of them."""
    to = F.element_at(F.array(*map(F.lit, ("running", "completed", "failed", "skipped", "running"))), (F.col("event_id") % 5 + 1).cast("int"))
    return changefeed.stage_states(t.events.select("user_id", F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"), to.alias("to")), ["user_id", "stage"])


# --- extraction -------------------------------------------------------------------------------------------------------

PYTHON = "def f{k}(x, y):\n    z = g{s}(x.a)\n    x.b = z\n    if y:\n        return h(z)\n    return y\n"
GO = "func F{k}(x *T, y int) int {{\n\tz := G{s}(x.A)\n\tx.B = z\n\tif y > 0 {{\n\t\treturn H(z)\n\t}}\n\treturn y\n}}\n"
TYPESCRIPT = "export function f{k}(x, y) {{\n  const z = g{s}(x.a);\n  x.b = z;\n  if (y) {{\n    return h(z);\n  }}\n  return y;\n}}\n"


def _sources(t: Tables, language: str, head: str, body: str, end: str) -> DataFrame:
    """A file for each brand with a function for each of its parts, in the order of their keys."""
    pieces, made = body.replace("{{", "{").replace("}}", "}").split("{k}"), None
    first, rest = pieces[0], pieces[1].split("{s}")
    made = F.concat(F.lit(first), F.col("p_partkey").cast("string"), F.lit(rest[0]), F.col("p_size").cast("string"), F.lit(rest[1]))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    parts = t.part.groupBy(brand.alias("brand")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey"), made.alias("m")))).alias("l"))
    content = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["m"]), "\n"))
    path = F.concat(F.col("brand"), F.lit(end))
    return parts.select(path.alias("path"), F.lit(language).alias("language"), F.encode(content, "UTF-8").alias("content"))


def _numbered(lines: int, head: int, module: str) -> str:
    return f"WITH p AS (SELECT lower(replace(p_brand, '#', '')) AS brand, p_partkey AS k, p_size AS s, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * {lines} + {head} AS pos FROM part), q AS (SELECT *, {module} AS module FROM p) "


def _facts(parsed: DataFrame) -> DataFrame:
    """Functions and edges as (label, of, what, line, detail)."""
    parsed = cut(parsed)  # read twice, parsed once
    nodes = parsed.select(F.explode("nodes").alias("n")).where("n.label = 'function'").select(F.lit("function").alias("label"), F.col("n.qualified").alias("of"), F.col("n.signature").alias("what"), F.col("n.start_line").cast("string").alias("line"), F.col("n.end_line").cast("string").alias("detail"))
    prop = lambda k: F.try_element_at("e.props", F.lit(k))
    edges = parsed.select(F.explode("edges").alias("e")).where(F.col("e.label").isin("calls", "reads", "writes", "control_flow", "data_dep"))
    detail = F.when(F.col("e.label") == "control_flow", F.concat_ws(" ", prop("branch_type"), prop("from_line"), prop("to_line"))).when(F.col("e.label") == "data_dep", F.concat_ws(" ", prop("var_name"), prop("def_line"), prop("use_line"), prop("def_type"))).otherwise(F.lit(""))
    what = F.when(F.col("e.label").isin("control_flow", "data_dep"), F.lit("")).otherwise(F.col("e.to_id"))
    return nodes.unionByName(edges.select(F.col("e.label").alias("label"), F.col("e.from_id").alias("of"), what.alias("what"), F.substring_index("e.call_site", ":", -1).alias("line"), detail.alias("detail")))


def _facts_sql(name: str, signature: str, last: int, g_: str, h: str, read: str, write: str) -> str:
    """What the sources say, by lines counted from a function's first: 1 call, 2 write, 3 branch, 4 and ``last`` - 1 or so returns."""
    back = 6 if last == 7 else 5
    fn = f"'function:' || module || '⋅{name}' || k"
    edge = lambda label, what, line, detail="''": f"SELECT '{label}', {fn}, {what}, CAST(pos + {line} AS VARCHAR), {detail} FROM q"
    flow = lambda kind, a, b: edge("control_flow", "''", a, f"'{kind} ' || (pos + {a}) || ' ' || (pos + {b})")
    use = lambda v, d, u, kind: edge("data_dep", "''", u, f"'{v} ' || (pos + {d}) || ' ' || (pos + {u}) || ' {kind}'")
    return " UNION ALL ".join([
        f"SELECT 'function' AS label, module || '.{name}' || k AS \"of\", {signature} AS what, CAST(pos AS VARCHAR) AS line, CAST(pos + {last} AS VARCHAR) AS detail FROM q",
        edge("calls", f"'{g_}' || s", 1), edge("calls", f"'{h}'", 4), edge("reads", f"'{read}'", 1), edge("writes", f"'{write}'", 2),
        flow("sequential", 1, 2), flow("sequential", 2, 3), flow("sequential", 3, back), flow("if_true", 3, 4), flow("return", 4, 4), flow("return", back, back),
        use("x", 0, 1, "parameter"), use("z", 1, 2, "return_value"), use("x", 0, 2, "parameter"), use("y", 0, 3, "parameter"), use("z", 1, 4, "return_value"), use("y", 0, back, "parameter"),
    ])


@query("extract_python", _numbered(7, 1, "brand") + _facts_sql("f", "'def f' || k || '(x, y)'", 5, "g", "h", "x.a", "x.b"), graph=False)
def _(t):
    return _facts(runner.parse_files(_sources(t, "python", "", PYTHON, ".py")))


@query("extract_go", _numbered(9, 3, "brand") + _facts_sql("F", "'func F' || k || '(x *T, y int) int'", 7, "G", "H", "x.A", "x.B") + " UNION ALL SELECT 'control_flow', 'function:' || module || '⋅F' || k, '', CAST(pos + 4 AS VARCHAR), 'sequential ' || (pos + 4) || ' ' || (pos + 6) FROM q", graph=False)
def _(t):
    return _facts(runner.parse_files(_sources(t, "go", "package p\n\n", GO, "/a.go")))


@query("extract_typescript", _numbered(9, 1, "brand") + _facts_sql("f", "'f' || k || '(x, y)'", 7, "g", "h", "x.a", "x.b"), graph=False)
def _(t):
    return _facts(runner.parse_files(_sources(t, "typescript", "", TYPESCRIPT, ".ts")))


SERVICE = "import \"fmt\"\n\n// R{k} serves.\ntype R{k} struct {{\n\tA int\n}}\n\ntype I{k} interface {{\n\tRun(s int) error\n}}\n\nfunc (r *R{k}) Run(s int) error {{ return nil }}\n\nfunc Setup{k}(r *gin.Engine) {{\n\tv := r.Group(\"/v{s}\")\n\tv.GET(\"/u/:id\", auth, Get)\n}}\n\nfunc get{k}(c *gin.Context) {{ id := c.Param(\"id\"); c.JSON(200, id) }}\n"


@query("extract_services", """WITH p AS (SELECT lower(replace(p_brand, '#', '')) AS b, p_partkey AS k, p_size AS s FROM part)
SELECT 'class' AS label, b || '.R' || k AS name, 'R' || k || ' serves.' AS a, '1' AS n, 'public' AS v FROM p UNION ALL SELECT 'class', b || '.I' || k, '', '1', 'public' FROM p
UNION ALL SELECT 'imports', 'file:' || b || '⋅s' || k || '⋅go', 'fmt', '', '' FROM p UNION ALL SELECT 'route', 'Get', 'GET /v' || s || '/u/:id', 'auth', '/v' || s FROM p
UNION ALL SELECT 'binding', 'function:' || b || '⋅get' || k, 'path_param', 'id', '' FROM p UNION ALL SELECT 'binding', 'function:' || b || '⋅get' || k, 'response', '', 'id' FROM p
UNION ALL SELECT 'function', b || '.R' || k || '.Run', 'func (r *R' || k || ') Run(s int) error', '', 'public' FROM p UNION ALL SELECT 'function', b || '.Setup' || k, 'func Setup' || k || '(r *gin.Engine)', '', 'public' FROM p UNION ALL SELECT 'function', b || '.get' || k, 'func get' || k || '(c *gin.Context)', '', 'private' FROM p""", graph=False)
def _(t):
    brand, key = F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_partkey").cast("string")
    body = F.replace(F.replace(F.lit("package p\n\n" + SERVICE.replace("{{", "{").replace("}}", "}")), F.lit("{k}"), key), F.lit("{s}"), F.col("p_size").cast("string"))
    parsed = cut(runner.parse_files(t.part.select(F.concat(brand, F.lit("/s"), key, F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.encode(body, "UTF-8").alias("content"))))
    nodes = parsed.select(F.explode("nodes").alias("n")).select("n.*")
    classes = nodes.where("label = 'class'").select("label", F.col("qualified").alias("name"), F.col("docstring").alias("a"), F.size("methods").cast("string").alias("n"), F.col("visibility").alias("v"))
    functions = nodes.where("label = 'function'").select("label", F.col("qualified").alias("name"), F.col("signature").alias("a"), F.lit("").alias("n"), F.col("visibility").alias("v"))
    edges, prop = parsed.select(F.explode("edges").alias("e")).select("e.*"), lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit(""))
    imports = edges.where("label = 'imports'").select("label", F.col("from_id").alias("name"), F.col("to_id").alias("a"), F.lit("").alias("n"), F.lit("").alias("v"))
    routes = edges.where("label = 'route'").select("label", F.col("to_id").alias("name"), F.concat(prop("http_method"), F.lit(" "), prop("http_path")).alias("a"), prop("middleware").alias("n"), prop("group_prefix").alias("v"))
    bound = edges.where(F.try_element_at("props", F.lit("source_type")).isNotNull()).select(F.lit("binding").alias("label"), F.col("from_id").alias("name"), prop("source_type").alias("a"), prop("param_name").alias("n"), prop("response_expr").alias("v"))
    return classes.unionByName(functions).unionByName(imports).unionByName(routes).unionByName(bound)


@query("extract_to_graph", _numbered(7, 1, "brand") + """, u AS (SELECT *, lead(k) OVER (PARTITION BY brand ORDER BY k) AS nxt FROM q)
SELECT 'calls' AS label, 'function:' || brand || '⋅f' || k AS from_id, CASE WHEN nxt IS NULL THEN 'missing' ELSE 'function:' || brand || '⋅f' || nxt END AS to_id, nxt IS NOT NULL AS resolved FROM u""", graph=False)
def _(t):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    by = "partition by p_brand order by p_partkey"
    rows = t.part.select(brand.alias("b"), "p_partkey", F.expr(f"lead(p_partkey) over ({by})").alias("nxt"))
    call = F.coalesce(F.concat(F.lit("f"), F.col("nxt").cast("string")), F.lit("missing"))
    body = F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit("():\n    return "), call, F.lit("()\n"))
    sources = rows.groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("m")))), lambda x: x["m"]), "\n").alias("text"))
    parsed = cut(runner.parse_files(sources.select(F.concat("b", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.encode("text", "UTF-8").alias("content"))))
    nodes = runner.merge_methods(runner.nodes_of(parsed, "r"))
    return link.link_all(runner.edges_of(parsed, "r"), nodes).where("label = 'calls'").select("label", "from_id", "to_id", "resolved")
