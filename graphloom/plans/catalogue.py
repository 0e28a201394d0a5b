"""The registered queries of the code-graph operators over the driver's tables, each with its SQL.

Every query reads whole tables; a limit stands only where an operator has one.  The SQL is written for DuckDB and
shares nothing with the Spark side but the graph's definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import ids, paths, text, vectors
from graphloom.operators import analyze, derive, link, memory, ranges, search, store, sync, traverse
from graphloom.plans import driver_graph as g
from graphloom.plans.driver_graph import Tables
from graphloom.streaming import changefeed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, graph: bool = True):
    """Register a function of the tables; ``sql`` starts after the graph's common table expressions (if ``graph``)."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = f"WITH RECURSIVE {g.SQL.strip()}{sql}" if graph else sql
        return f

    return register


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["blast_radius"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- scans, lookups, computed columns ---------------------------------------------------------------------------


@query("scan_nodes", " SELECT node_id, label, qualified, file_path, repo_slug, start_line, end_line FROM nodes")
def _(t):
    return store.scan_nodes(g.nodes(t)).select("node_id", "label", "qualified", "file_path", "repo_slug", "start_line", "end_line")


@query("list_ids", " SELECT node_id FROM nodes WHERE label IN ('customer', 'supplier', 'part')")
def _(t):
    return store.scan_nodes(g.nodes(t), labels=["customer", "supplier", "part"]).select("node_id")


@query("list_file_paths", " SELECT DISTINCT file_path FROM nodes WHERE label IN ('customer', 'supplier', 'part') AND file_path <> ''")
def _(t):
    return derive.file_paths(g.nodes(t), ("customer", "supplier", "part"))


@query("prefix_scan", " SELECT node_id, file_path FROM nodes WHERE starts_with(file_path, 'parts/Brand1')")
def _(t):
    return store.scan_nodes(g.nodes(t), file_path_prefix="parts/Brand1").select("node_id", "file_path")


@query("find_node", " SELECT node_id, qualified FROM nodes WHERE qualified = 'ASIA.NATION_2' ORDER BY node_id LIMIT 1")
def _(t):
    return store.find_by_qualified(g.nodes(t), "ASIA.NATION_2").select("node_id", "qualified")


@query("resolve_symbol_suffix", """ SELECT node_id, qualified, CASE WHEN count(*) OVER () = 1 THEN 'suffix' ELSE 'ambiguous' END AS status FROM nodes WHERE ends_with(qualified, '.O7')""")
def _(t):
    return store.resolve_symbol(g.nodes(t), "O7").select("node_id", "qualified", "status")


@query("node_ids", """ SELECT node_id, label || ':' || replace(replace(qualified, '.', '⋅'), '/', '⋅') AS graph_id, CASE WHEN strpos(qualified, '.') > 1 THEN split_part(qualified, '.', 1) END AS package,
  '.' || regexp_extract(qualified, '[^.]*$') AS suffix FROM nodes""")
def _(t):
    q = F.col("qualified")
    return g.nodes(t).select("node_id", ids.node_id(F.col("label"), q).alias("graph_id"), ids.package_of(q).alias("package"), ids.suffix_of(q).alias("suffix"))


DEGREES = """, e AS (SELECT from_id AS node_id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT to_id, 1, 0 FROM calls),
d AS (SELECT node_id, sum(i) AS i, sum(o) AS o FROM e GROUP BY node_id),
f AS (SELECT n.node_id, CAST(coalesce(i, 0) AS BIGINT) AS call_count, CAST(coalesce(o, 0) AS BIGINT) AS callee_count FROM nodes n LEFT JOIN d USING (node_id) WHERE n.label = 'part')
"""


@query("degree_centrality", DEGREES + "SELECT node_id, call_count, callee_count, call_count + callee_count AS centrality FROM f")
def _(t):
    return derive.degrees(g.nodes(t), g.calls(t), node_label="part").select("node_id", "call_count", "callee_count", "centrality")


@query("entry_points_leaves", DEGREES + "SELECT node_id, callee_count = 0 AS is_leaf, call_count = 0 AND callee_count > 0 AS is_entry_point FROM f")
def _(t):
    return derive.degrees(g.nodes(t), g.calls(t), node_label="part").select("node_id", "is_leaf", "is_entry_point")


@query("computed_symbol_count", """ SELECT n.node_id, count(c.node_id) AS symbol_count FROM nodes n LEFT JOIN (SELECT from_id, node_id FROM defines JOIN nodes ON to_id = node_id AND label IN ('customer', 'supplier')) c
  ON c.from_id = n.node_id WHERE n.label = 'nation' GROUP BY n.node_id""")
def _(t):
    return derive.symbol_count(g.nodes(t), g.defines(t), "nation", ("customer", "supplier"))


@query("index_coverage", """SELECT 100.0 * count(text) / count(*) AS parse_pct, 100.0 * count(quality) / count(*) AS embed_pct, 100.0 * sum(toxic) / count(*) AS summary_pct, 100.0 * sum(quality) / count(quality) AS resolve_pct
  FROM documents d LEFT JOIN labels l USING (doc_id)""", graph=False)
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    count = {"files": F.count("*"), "parsed": F.count("text"), "nodes": F.count("*"), "embedded": F.count("quality"), "summarised": F.sum("toxic"), "edges": F.count("quality"), "resolved": F.sum("quality")}
    return derive.coverage(rows.agg(*(c.alias(n) for n, c in count.items())))


# --- traversal --------------------------------------------------------------------------------------------------


def _bfs_sql(edges: str, seeds: str, depth: int, reverse: bool = False, keep_seed: bool = False) -> str:
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    seed = "seed_id, " if keep_seed else ""
    return f""", seeds AS ({seeds}),
walk AS (SELECT {seed}node_id, 0 AS hop FROM seeds UNION SELECT {'w.seed_id, ' if keep_seed else ''}e.{b}, w.hop + 1 FROM walk w JOIN ({edges}) e ON e.{a} = w.node_id WHERE w.hop < {depth}),
hops AS (SELECT {seed}node_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY {seed}node_id HAVING min(hop) > 0)
"""


CUSTOMERS = "SELECT node_id FROM nodes WHERE label = 'customer'"


def _all(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select(F.lit("*").alias("seed_id"), "node_id")


@query("trace_forward_d3", _bfs_sql("SELECT * FROM calls", CUSTOMERS, 3) + "SELECT node_id, hop FROM hops")
def _(t):
    return traverse.traverse(_all(g.nodes(t), "customer"), g.calls(t), ["calls"], "forward", 3, via=False).select("node_id", "hop")


@query("trace_reverse_d3", _bfs_sql("SELECT * FROM calls", "SELECT node_id FROM nodes WHERE label = 'supplier'", 3, True) + "SELECT node_id, hop FROM hops")
def _(t):
    return traverse.traverse(_all(g.nodes(t), "supplier"), g.calls(t), ["calls"], "reverse", 3, via=False).select("node_id", "hop")


@query("trace_multi_label", _bfs_sql("SELECT * FROM tests", "SELECT node_id FROM nodes WHERE label = 'orders'", 5) + """, by_tests AS (SELECT node_id, hop, 'tests' AS label FROM hops),
walk2 AS (SELECT node_id, 0 AS hop FROM seeds UNION SELECT e.to_id, w.hop + 1 FROM walk2 w JOIN calls e ON e.from_id = w.node_id WHERE w.hop < 5),
by_calls AS (SELECT node_id, CAST(min(hop) AS INTEGER) AS hop, 'calls' AS label FROM walk2 GROUP BY node_id HAVING min(hop) > 0)
SELECT * FROM by_tests UNION ALL SELECT * FROM by_calls WHERE node_id NOT IN (SELECT node_id FROM by_tests)""")
def _(t):
    edges = g.calls(t).unionByName(g.tests(t))
    return traverse.traverse(_all(g.nodes(t), "orders"), edges, ["tests", "calls"], "forward", via=False).select("node_id", "hop", "label")


@query("trace_cyclic_d4", _bfs_sql("SELECT DISTINCT from_id, to_id FROM flows", "SELECT DISTINCT from_id AS seed_id, from_id AS node_id FROM flows", 4, keep_seed=True) + "SELECT seed_id, node_id, hop FROM hops")
def _(t):
    flows = g.flows(t)
    seeds = flows.select(F.col("from_id").alias("seed_id"), F.col("from_id").alias("node_id")).distinct()
    return traverse.traverse(seeds, flows.select("label", "from_id", "to_id").distinct(), ["data_flow"], "forward", 4, via=False).select("seed_id", "node_id", "hop")


@query("trace_both_directions", _bfs_sql("SELECT from_id, to_id FROM defines UNION ALL SELECT to_id, from_id FROM defines", "SELECT node_id FROM nodes WHERE label = 'nation'", 2) + "SELECT node_id, hop FROM hops")
def _(t):
    return traverse.traverse(_all(g.nodes(t), "nation"), g.defines(t), ["defines"], "both", 2).select("node_id", "hop")


@query("neighbors_1hop", """, every AS (
  SELECT 'calls' AS label, from_id, to_id, NULL AS detail, NULL AS arg FROM calls UNION ALL SELECT 'data_flow', from_id, to_id, 'f' || from_id, 'a' || to_id FROM defines
  UNION ALL SELECT 'reads', from_id, to_id, 'r' || to_id, NULL FROM tests UNION ALL SELECT 'writes', to_id, from_id, 'w' || from_id, NULL FROM tests),
r AS (SELECT from_id AS node_id, 'callees' AS kind, to_id AS other_id, NULL AS detail FROM every WHERE label = 'calls' UNION ALL SELECT to_id, 'callers', from_id, NULL FROM every WHERE label = 'calls'
  UNION ALL SELECT from_id, 'sinks', to_id, detail FROM every WHERE label = 'data_flow' UNION ALL SELECT to_id, 'sources', from_id, arg FROM every WHERE label = 'data_flow'
  UNION ALL SELECT from_id, label, to_id, detail FROM every WHERE label IN ('reads', 'writes')),
s AS (SELECT r.*, n.qualified AS other_qualified, row_number() OVER (PARTITION BY r.node_id, kind ORDER BY n.qualified, other_id, detail NULLS FIRST) AS rn FROM r JOIN nodes n ON n.node_id = other_id)
SELECT node_id, kind, other_id, other_qualified, detail FROM s WHERE rn <= CASE WHEN kind IN ('callees', 'callers') THEN 30 ELSE 20 END""")
def _(t):
    nodes = g.nodes(t)
    prop = lambda k, c: F.create_map(F.lit(k), c)
    none = F.lit(None).cast("map<string,string>")
    flow = g.defines(t).select(F.lit("data_flow").alias("label"), "from_id", "to_id", F.create_map(F.lit("field_path"), F.concat(F.lit("f"), "from_id"), F.lit("arg_expr"), F.concat(F.lit("a"), "to_id")).alias("props"))
    reads = g.tests(t).select(F.lit("reads").alias("label"), "from_id", "to_id", prop("field", F.concat(F.lit("r"), "to_id")).alias("props"))
    writes = g.tests(t).select(F.lit("writes").alias("label"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), prop("field", F.concat(F.lit("w"), "from_id")).alias("props"))
    edges = g.calls(t).select("label", "from_id", "to_id", none.alias("props")).unionByName(flow).unionByName(reads).unionByName(writes)
    return traverse.neighbour_rows(edges, nodes, nodes)


BLAST = _bfs_sql("SELECT * FROM calls", "SELECT node_id FROM nodes WHERE label = 'supplier'", 3, True)


@query("blast_radius", BLAST + "SELECT h.node_id, qualified, CASE WHEN strpos(qualified, '.') > 1 THEN split_part(qualified, '.', 1) END AS module, file_path, hop FROM hops h JOIN nodes n ON n.node_id = h.node_id")
def _(t):
    nodes = g.nodes(t)
    return analyze.blast_radius(_all(nodes, "supplier"), g.calls(t), nodes)


FLOW_WALK = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id, field_path, mutation_type NULLS FIRST) AS rn FROM flows),
f AS (SELECT * FROM numbered WHERE rn <= 50),
reach AS (SELECT 'user:' || c_custkey AS node, 0 AS d FROM customer WHERE c_nationkey = 3 UNION SELECT f.to_id, reach.d + 1 FROM reach JOIN f ON f.from_id = reach.node WHERE reach.d < 10),
nearest AS (SELECT node, min(d) AS d FROM reach GROUP BY node), hops AS (SELECT CAST(n.d + 1 AS INTEGER) AS depth, f.* FROM nearest n JOIN f ON f.from_id = n.node WHERE n.d < 10)
"""


def _flow_seeds(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey = 3").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("node_id"))


@query("field_flow_hops", FLOW_WALK + "SELECT field_path, depth, from_id, to_id, mutation_type, mutation_type IS NOT NULL AS mutates FROM hops")
def _(t):
    return analyze.field_flow_hops(_flow_seeds(t), g.flows(t)).select("field_path", "depth", "from_id", "to_id", "mutation_type", "mutates")


@query("field_flow_chains", FLOW_WALK + """SELECT field_path, count(*) AS n_hops, count(mutation_type) AS n_mutations, max(depth) AS depth, (min(struct_pack(depth := depth, to_id := to_id)) FILTER (mutation_type IS NOT NULL)).to_id AS taint_node, min(depth) FILTER (mutation_type IS NOT NULL) AS taint_depth
FROM hops GROUP BY field_path""")
def _(t):
    return analyze.field_flow_chains(_flow_seeds(t), g.flows(t))


@query("find_mutations", " SELECT from_id, to_id, field_path, mutation_type FROM flows WHERE mutation_type IS NOT NULL AND to_id IN (SELECT 'user:' || c_custkey FROM customer) ORDER BY 1, 2, 3, 4 LIMIT 100")
def _(t):
    users = t.customer.select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("node_id"))
    return traverse.find_mutations(g.flows(t), users)


# --- diff impact, tests -----------------------------------------------------------------------------------------

PATCH_SQL = """, diffs AS (SELECT 'parts/Brand' || (o_orderkey % 25 + 1) AS path, '@@ -1,3 +' || (o_orderkey % 500 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',' || o_orderkey % 7 END || ' @@ x' AS patch FROM orders),
h AS (SELECT path, CAST(regexp_extract(patch, '\\+(\\d+)(?:,(\\d+))? @@', 1) AS INTEGER) AS lo, regexp_extract(patch, '\\+(\\d+)(?:,(\\d+))? @@', 2) AS n FROM diffs),
ranges AS (SELECT DISTINCT path AS file_path, lo AS start, CASE WHEN n = '' THEN lo ELSE lo + CAST(n AS INTEGER) - 1 END AS "end" FROM h WHERE n <> '0'),
none AS (SELECT DISTINCT path FROM h WHERE n = '0')
"""


def _diffs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(","), (k % 7).cast("string")))
    patch = F.concat(F.lit("@@ -1,3 +"), (k % 500 + 1).cast("string"), n, F.lit(" @@ x"))
    return t.orders.select(F.concat(F.lit("parts/Brand"), (k % 25 + 1).cast("string")).alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status"), patch.alias("patch"))


@query("hunk_parse", PATCH_SQL + 'SELECT file_path, start, "end" FROM ranges')
def _(t):
    return analyze.diff_ranges(_diffs(t)).where("start is not null").distinct()


OVERLAP = PATCH_SQL + """, changed AS (SELECT DISTINCT n.node_id, n.qualified, n.file_path FROM nodes n JOIN ranges r ON n.file_path = r.file_path AND n.start_line <= r."end" AND n.end_line >= r.start WHERE n.label = 'part'
  UNION SELECT n.node_id, n.qualified, n.file_path FROM nodes n JOIN none ON none.path = n.file_path WHERE n.label = 'part')
"""


@query("diff_impact_overlap", OVERLAP + "SELECT node_id, qualified, file_path FROM changed")
def _(t):
    return ranges.overlapping(store.scan_nodes(g.nodes(t), labels=["part"]), analyze.diff_ranges(_diffs(t))).select("node_id", "qualified", "file_path")


@query("diff_impact_blast", OVERLAP + _bfs_sql("SELECT * FROM calls", "SELECT node_id FROM changed", 3, True) + """SELECT node_id, qualified, CAST(0 AS INTEGER) AS hop, 'changed' AS role FROM changed UNION ALL
SELECT h.node_id, n.qualified, h.hop, 'affected' FROM hops h JOIN nodes n ON n.node_id = h.node_id WHERE h.node_id NOT IN (SELECT node_id FROM changed)""")
def _(t):
    nodes = g.nodes(t)
    as_code = nodes.withColumn("label", F.when(F.col("label") == "part", "function").otherwise(F.col("label")))
    return analyze.diff_impact(_diffs(t), g.calls(t), as_code).select("node_id", "qualified", "hop", "role")


@query("tests_for", """, chain AS (SELECT from_id, to_id FROM tests UNION ALL SELECT to_id, 'supplier:' || l_suppkey FROM tests JOIN lineitem ON 'part:' || l_partkey = to_id AND 'orders:' || l_orderkey = from_id),
seeds AS (SELECT node_id FROM nodes WHERE label = 'supplier'),
walk AS (SELECT node_id, 0 AS hop FROM seeds UNION SELECT e.from_id, w.hop + 1 FROM walk w JOIN chain e ON e.to_id = w.node_id WHERE w.hop < 5),
hops AS (SELECT node_id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY node_id HAVING min(hop) > 0)
SELECT node_id, qualified, hop FROM hops JOIN nodes USING (node_id)""")
def _(t):
    nodes, tests = g.nodes(t), g.tests(t)
    further = tests.join(t.lineitem.select(F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("to_id"), "l_suppkey"), ["from_id", "to_id"])
    further = further.select("label", F.col("to_id").alias("from_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("to_id"), "call_site")
    return analyze.tests_for(_all(nodes, "supplier"), tests.unionByName(further), nodes)


@query("tests_for_direct", """, d AS (SELECT DISTINCT from_id AS node_id FROM tests), n AS (SELECT d.node_id, qualified FROM d JOIN nodes USING (node_id)) SELECT min(node_id) AS node_id, qualified, CAST(1 AS INTEGER) AS hop FROM n GROUP BY qualified""")
def _(t):
    nodes = g.nodes(t)
    return analyze.tests_for(_all(nodes, "part"), g.tests(t), nodes, direct=True)


@query("subjects_for", _bfs_sql("SELECT * FROM tests", "SELECT DISTINCT from_id AS node_id FROM tests", 5) + """, w2 AS (SELECT node_id, 0 AS hop FROM seeds UNION SELECT e.to_id, w.hop + 1 FROM w2 w JOIN calls e ON e.from_id = w.node_id WHERE w.hop < 5),
every AS (SELECT node_id, hop, 0 AS o FROM hops UNION ALL SELECT node_id, CAST(min(hop) AS INTEGER), 1 FROM w2 GROUP BY node_id HAVING min(hop) > 0),
first AS (SELECT node_id, arg_min(hop, o) AS hop FROM every GROUP BY node_id)
SELECT node_id, qualified, hop FROM first JOIN nodes USING (node_id)""")
def _(t):
    nodes, tests = g.nodes(t), g.tests(t)
    return analyze.subjects_for(tests.select(F.col("from_id").alias("node_id")).distinct(), tests.unionByName(g.calls(t)), nodes)


# --- linkers ------------------------------------------------------------------------------------------------------

LINK_SQL = """, code AS (SELECT node_id, CASE label WHEN 'orders' THEN 'function' WHEN 'part' THEN 'function' WHEN 'customer' THEN 'class' ELSE label END AS label, name, qualified, file_path FROM nodes),
raw AS (SELECT 'customer:' || o_custkey AS from_id, CASE o_orderkey % 5 WHEN 0 THEN 'orders.' || o_orderstatus || '.O' || o_orderkey WHEN 1 THEN 'x.O' || o_orderkey WHEN 2 THEN 'Missing' || o_orderkey WHEN 3 THEN 'orders:' || o_orderkey ELSE 'NATION_' || o_orderkey % 25 END AS to_id FROM orders),
exact AS (SELECT qualified, max(node_id) AS id FROM code WHERE qualified <> '' GROUP BY qualified),
suffix AS (SELECT '.' || regexp_extract(qualified, '[^.]*$') AS s, CASE WHEN count(*) = 1 THEN min(node_id) ELSE min(CASE WHEN NOT (contains(file_path, '_test.') OR starts_with(name, 'Test') OR starts_with(name, 'Benchmark')) THEN node_id END) END AS id FROM code WHERE label = 'function' GROUP BY 1),
linked AS (SELECT r.from_id, r.to_id AS raw, CASE WHEN contains(r.to_id, ':') THEN r.to_id ELSE coalesce(e.id, p.id, s.id) END AS id,
  CASE WHEN contains(r.to_id, ':') THEN 'id' WHEN e.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'package' WHEN s.id IS NOT NULL THEN 'suffix' END AS strategy
  FROM raw r LEFT JOIN code c ON c.node_id = r.from_id LEFT JOIN exact e ON e.qualified = r.to_id LEFT JOIN exact p ON NOT contains(r.to_id, '.') AND p.qualified = split_part(c.qualified, '.', 1) || '.' || r.to_id
  LEFT JOIN suffix s ON s.s = '.' || regexp_extract(r.to_id, '[^.]*$'))
"""


def _code(t: Tables) -> DataFrame:
    kinds = {"orders": "function", "part": "function", "customer": "class"}
    label = F.col("label")
    for k, v in kinds.items():
        label = F.when(F.col("label") == k, v).otherwise(label)
    return g.nodes(t).withColumn("label", label)


def _raw_calls(t: Tables) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    to = F.when(k % 5 == 0, F.concat(F.lit("orders."), F.col("o_orderstatus"), F.lit(".O"), key)).when(k % 5 == 1, F.concat(F.lit("x.O"), key)).when(k % 5 == 2, F.concat(F.lit("Missing"), key))
    to = to.when(k % 5 == 3, F.concat(F.lit("orders:"), key)).otherwise(F.concat(F.lit("NATION_"), (k % 25).cast("string")))
    return t.orders.select(F.lit("calls").alias("label"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("from_id"), to.alias("to_id"))


@query("link_resolve", LINK_SQL + "SELECT from_id, raw AS to_id, id AS resolved_id, strategy FROM linked")
def _(t):
    return link.resolve_targets(_raw_calls(t), _code(t)).select("from_id", "to_id", "resolved_id", "strategy")


@query("link_stats", LINK_SQL + "SELECT 'calls' AS label, count(*) AS processed, count(id) AS resolved, count(*) - count(id) AS unresolved FROM linked")
def _(t):
    return link.link_stats(link.CallLinker().link(_raw_calls(t), _code(t)))


@query("link_classify", """ SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'calls' WHEN event_type = 'view' THEN 'tests' WHEN event_type IN ('click', 'signup') THEN 'constructs' ELSE 'calls' END AS label FROM events""")
def _(t):
    name = F.when(F.col("event_type") == "view", "TestX").when(F.col("event_type") == "signup", "NewX").otherwise("Do")
    path = F.when(F.col("event_type") == "click", "a/wire.go").otherwise("a/x.go")
    return t.events.select("event_id", link.call_label(path, name, F.col("event_id") % 11 != 0).alias("label"))


@query("link_defines_prefix", """, member AS (SELECT node_id, qualified, file_path FROM nodes WHERE label IN ('customer', 'supplier')),
owner AS (SELECT m.node_id, arg_max(c.node_id, length(c.qualified)) AS id FROM member m JOIN nodes c ON c.label = 'nation' AND starts_with(m.qualified, c.qualified || '.') GROUP BY m.node_id)
SELECT 'defines' AS label, id AS from_id, node_id AS to_id FROM owner
UNION ALL SELECT 'defines', 'file:' || m.file_path, m.node_id FROM (SELECT node_id, file_path FROM nodes WHERE label = 'part' UNION ALL SELECT node_id, file_path FROM nodes WHERE label = 'nation') m""")
def _(t):
    nodes = g.nodes(t)
    label = F.when(F.col("label").isin("customer", "supplier", "part"), "function").when(F.col("label") == "nation", "class")
    code = nodes.withColumn("label", label).where("label is not null").select("node_id", "label", "qualified", "file_path")
    files = code.select(F.concat(F.lit("file:"), F.col("file_path")).alias("node_id"), F.lit("file").alias("label"), F.lit(None).cast("string").alias("qualified"), "file_path").distinct()
    return link.defines_edges(code.unionByName(files))


@query("implements_division", """, have AS (SELECT DISTINCT 'supplier:' || l_suppkey AS type, 'm' || l_partkey % 997 AS name FROM lineitem),
want AS (SELECT DISTINCT 'customer:' || o_custkey AS iface, 'm' || o_orderkey % 997 AS name FROM orders),
needed AS (SELECT iface, count(*) AS n FROM want GROUP BY iface),
met AS (SELECT type, iface, count(*) AS n FROM have JOIN want USING (name) GROUP BY type, iface)
SELECT 'implements' AS label, type AS from_id, iface AS to_id FROM met JOIN needed USING (iface) WHERE met.n = needed.n""")
def _(t):
    def methods(rows: DataFrame, node: str, key: str, number: str, receiver: str) -> DataFrame:
        name = F.concat(F.lit("m"), (F.col(number) % 997).cast("string"))
        made = F.struct(name.alias("name"), F.concat(F.lit("f[T any] ("), name, F.lit(")")).alias("signature"), F.lit(receiver).alias("receiver"))
        return rows.groupBy(F.concat(F.lit(f"{node}:"), F.col(key).cast("string")).alias("node_id")).agg(F.sort_array(F.collect_set(made)).alias("methods"))

    types, ifaces = methods(t.lineitem, "supplier", "l_suppkey", "l_partkey", "T"), methods(t.orders, "customer", "o_custkey", "o_orderkey", "")
    return link.implements_edges(types.unionByName(ifaces).withColumn("label", F.lit("class")))


@query("signature_normalise", "SELECT p_partkey, 'F (' || p_name || ')' AS signature FROM part", graph=False)
def _(t):
    raw = F.concat(F.lit(" F[T any, S[int]]  ("), F.col("p_name"), F.lit(") "))
    return t.part.select("p_partkey", text.bare_signature(raw).alias("signature"))


# --- search -------------------------------------------------------------------------------------------------------

COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _vector(t: Tables, vec_id: int = 0) -> list[float]:
    row = t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


@query("vector_topk", f"SELECT e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20", graph=False)
def _(t):
    return search.vector_search(t.embeddings, _vector(t), 20, id_column="vec_id")


@query("vector_min_score", f"SELECT vec_id, score FROM (SELECT e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 1000", graph=False)
def _(t):
    return search.vector_search(t.embeddings, _vector(t), 1000, 0.1, id_column="vec_id")


SIMILAR = f"WITH s AS (SELECT e.vec_id, e.label, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3), f AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 11), c AS (SELECT * FROM f WHERE vec_id <> 3 ORDER BY score DESC, vec_id LIMIT 10) "


@query("similar_to", SIMILAR + "SELECT vec_id, score FROM c", graph=False)
def _(t):
    return search.similar_to(t.embeddings, 3, _vector(t, 3), 10, id_column="vec_id")


@query("similar_excl_group", SIMILAR + "SELECT vec_id, score FROM c WHERE label <> (SELECT label FROM embeddings WHERE vec_id = 3)", graph=False)
def _(t):
    label = t.embeddings.where("vec_id = 3").select("label").first()
    return search.similar_to(t.embeddings, 3, _vector(t, 3), 10, ("label", label[0] if label else None), id_column="vec_id")


@query("vector_normalize", """SELECT vec_id, CAST(32 AS INTEGER) AS dim, round(v[1] / n, 6) AS first, round(v[32] / n, 6) AS last FROM (
  SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""", graph=False)
def _(t):
    v = vectors.fit(F.col("embedding"), 32)
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"))


FOLD = f"replace(translate(lower(text), '{text.ACCENTS}', '{text.FOLDED}'), 'ß', 'ss')"
TERMS = ["idiot", "clown", "reason", "thereon"]


def _bm25_sql(where: str = "") -> str:
    return f"""toks AS (SELECT doc_id, list_filter(string_split_regex({FOLD}, '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents {where}),
lens AS (SELECT doc_id, len(t) AS length, t FROM toks WHERE len(t) > 0), tot AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
tf AS (SELECT doc_id, length, term, CAST(len(list_filter(t, lambda x: x = term)) AS BIGINT) AS tf FROM lens, (SELECT unnest({TERMS!r}) AS term)),
hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hit JOIN df USING (term), tot GROUP BY doc_id)
"""


@query("bm25_topk", "WITH " + _bm25_sql() + "SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20", graph=False)
def _(t):
    return search.bm25_scores(t.documents, "doc_id", {"text": text.word_tokens(F.col("text"))}, TERMS).orderBy(F.desc("score"), "doc_id").limit(20)


@query("bm25_filtered", "WITH " + _bm25_sql("WHERE lang = 'en'") + "SELECT doc_id, score FROM bm", graph=False)
def _(t):
    return search.bm25_scores(t.documents.where("lang = 'en'"), "doc_id", {"text": text.word_tokens(F.col("text"))}, TERMS)


ARMS = "WITH " + _bm25_sql() + f""", ta AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20)),
va AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20)),
fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM ta UNION ALL SELECT * FROM va) GROUP BY id)
"""


@query("rrf_fusion", ARMS + "SELECT id, score FROM fused", graph=False)
def _(t):
    by_text = search.bm25_scores(t.documents, "doc_id", {"text": text.word_tokens(F.col("text"))}, TERMS).orderBy(F.desc("score"), "doc_id").limit(20).withColumnRenamed("doc_id", "id")
    by_vector = search.vector_search(t.embeddings, _vector(t), 20, id_column="vec_id").withColumnRenamed("vec_id", "id")
    return search.fuse([search.ranked(by_text, "id"), search.ranked(by_vector, "id")], id_column="id")


HITS = """, hits AS (SELECT 'customer:' || c_custkey AS node_id, round(c_acctbal / 10000, 6) AS score FROM customer ORDER BY score DESC, node_id LIMIT 20),
best AS (SELECT node_id AS parent, score AS ps, row_number() OVER (ORDER BY score DESC, node_id) AS place FROM hits ORDER BY score DESC, node_id LIMIT 5),
reached AS (SELECT from_id AS node_id, place, 0 AS side, ps FROM calls JOIN best ON to_id = parent UNION ALL SELECT to_id, place, 1, ps FROM calls JOIN best ON from_id = parent),
grown AS (SELECT node_id, score, false AS expanded FROM hits UNION ALL SELECT node_id, round(arg_min(ps, place * 2 + side) * 0.6, 6), true FROM reached WHERE node_id NOT IN (SELECT node_id FROM hits) GROUP BY node_id)
"""


def _hits(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.round(F.col("c_acctbal") / 10000, 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(20)


@query("graph_expand", HITS + "SELECT node_id, score, expanded FROM grown")
def _(t):
    return search.expand(_hits(t), g.calls(t))


@query("concept_rerank", """SELECT p_partkey AS node_id, round(p_retailprice / 1000 * CASE WHEN lower(p_type) = 'economy' OR split_part(p_name, ' ', 2) = 'bolt' THEN 2 ELSE 1 END * CASE WHEN p_size > 0 THEN least(1 + 0.1 * ln(1 + p_size), 1.3) ELSE 1 END, 6) AS score FROM part""", graph=False)
def _(t):
    hits = t.part.select(F.col("p_partkey").alias("node_id"), (F.col("p_retailprice") / 1000).alias("score"), F.array(F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("concepts"), F.col("p_size").alias("centrality"))
    return search.concept_rerank(hits, "an economy bolt").select("node_id", "score")


@query("hybrid_query", "WITH " + _bm25_sql() + f""", vs AS (SELECT e.vec_id AS id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id IN (SELECT doc_id FROM documents)),
va AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM vs WHERE score >= 0.2 ORDER BY score DESC, 'user:' || id LIMIT 20)),
tr AS (SELECT doc_id AS id, score FROM bm ORDER BY score DESC, 'user:' || doc_id LIMIT 20),
arms AS (SELECT id, row_number() OVER (ORDER BY score DESC, 'user:' || id) AS rank FROM tr UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, 'user:' || id) FROM (SELECT * FROM vs WHERE score >= 0.2 ORDER BY score DESC, 'user:' || id LIMIT 20)),
calls AS (SELECT o_custkey % 500 AS a, o_orderkey % 500 AS b FROM orders), deg AS (SELECT id, count(*) AS c FROM (SELECT a AS id FROM calls UNION ALL SELECT b FROM calls) GROUP BY id),
fused AS (SELECT id, round(sum(1.0 / (60 + rank)) * least(greatest(ln(1 + coalesce(any_value(c), 0)), 1), 2), 6) AS score FROM arms LEFT JOIN deg USING (id) GROUP BY id),
best AS (SELECT id AS parent, score AS ps, row_number() OVER (ORDER BY score DESC, 'user:' || id) AS place FROM fused ORDER BY score DESC, 'user:' || id LIMIT 5),
reached AS (SELECT a AS id, place, 0 AS side, ps FROM calls JOIN best ON b = parent UNION ALL SELECT b, place, 1, ps FROM calls JOIN best ON a = parent),
grown AS (SELECT id, score, false AS expanded FROM fused UNION ALL SELECT id, round(arg_min(ps, place * 2 + side) * 0.6, 6), true FROM reached WHERE id NOT IN (SELECT id FROM fused) GROUP BY id),
scored AS (SELECT g.id, expanded, round(g.score * CASE WHEN coalesce(lang = 'en', false) THEN 2 ELSE 1 END * CASE WHEN NOT expanded AND coalesce(c, 0) > 0 THEN least(1 + 0.1 * ln(1 + c), 1.3) ELSE 1 END, 6) AS score FROM grown g LEFT JOIN documents d ON d.doc_id = g.id LEFT JOIN deg ON deg.id = g.id)
SELECT 'user:' || id AS node_id, score, expanded FROM scored ORDER BY score DESC, node_id LIMIT 10""".replace("coalesce(lang = 'en', false)", "coalesce(lang || 'x' = 'enx', false)"), graph=False)
def _(t):
    label = lambda c: F.concat(F.lit("user:"), c.cast("string"))
    docs = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    nodes = docs.select(label(F.col("doc_id")).alias("node_id"), F.lit("function").alias("label"), F.array(F.concat(F.col("lang"), F.lit("x"))).alias("concepts"), F.lit("").alias("file_path"), "embedding", "text")
    calls = t.orders.select(F.lit("calls").alias("label"), label(F.col("o_custkey") % 500).alias("from_id"), label(F.col("o_orderkey") % 500).alias("to_id"))
    centrality = derive.degrees(nodes, calls).select("node_id", "centrality")
    return search.hybrid_query(nodes, calls, centrality, " ".join(TERMS) + " enx", _vector(t), 10, 0.2, fields={"text": text.word_tokens(F.col("text"))})


@query("context_builder", """SELECT doc_id, substring('[' || upper(lang) || '] ' || source, 1, 200) || ' — ' || substring(text, 1, 500) || ' Concepts: ' || substring(lang || ', ' || source, 1, 100) || '.' || chr(10) || 'Signature: ' || substring(source || '()', 1, 300) || chr(10) || '---' || chr(10) || substring(text, 1, 4100) AS context FROM documents WHERE length(text) > 0""", graph=False)
def _(t):
    docs = t.documents.where("length(text) > 0")
    body = search.context_text(search.embed_budget(0), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"), F.array("lang", "source"), F.concat("source", F.lit("()")), F.col("text"))
    return docs.select("doc_id", body.alias("context"))


@query("content_hash_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1", graph=False)
def _(t):
    return t.documents.where("text is not null").groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


# --- API surface, security ----------------------------------------------------------------------------------------


def _routes(t: Tables) -> DataFrame:
    url = F.col("url")
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    mw = F.when(F.col("page_id") % 3 == 0, "logger,jwtGuard").when(F.col("page_id") % 3 == 1, "cors").otherwise("")
    props = F.create_map(F.lit("http_method"), F.lit("get"), F.lit("http_path"), path, F.lit("middleware"), mw)
    route = t.pages.select(F.lit("route").alias("label"), F.lit("file:pages").alias("from_id"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("to_id"), F.concat(F.lit("pages.go:"), F.col("page_id").cast("string")).alias("call_site"), props.alias("props"))
    response = F.when(F.col("page_id") % 4 == 0, "UserEmail").when(F.col("page_id") % 4 == 1, "CardCvv").otherwise("Plain")
    bound = t.pages.select(F.lit("data_flow").alias("label"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("from_id"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("to_id"), F.lit(None).cast("string").alias("call_site"), F.create_map(F.lit("source_type"), F.lit("response"), F.lit("response_expr"), response).alias("props"))
    return route.unionByName(bound)


@query("api_surface", """SELECT 'GET' AS method, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, 'page:' || page_id AS handler, 'pages.go' AS file, CAST(page_id AS INTEGER) AS line, CASE WHEN page_id % 3 = 0 THEN 'jwtGuard' ELSE '' END AS auth, page_id % 3 = 0 AS has_auth,
  CASE page_id % 4 WHEN 0 THEN 'UserEmail' WHEN 1 THEN 'CardCvv' ELSE 'Plain' END AS responses, CASE page_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'financial' ELSE '' END AS pii FROM pages""", graph=False)
def _(t):
    nodes = t.pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("node_id"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("qualified"))
    s = analyze.api_surface(_routes(t), nodes)
    return s.select("method", "path", "handler", "file", "line", F.array_join("auth_chain", ",").alias("auth"), "has_auth", F.array_join("responses", ",").alias("responses"), F.array_join(F.transform("pii", lambda p: p["kind"]), ",").alias("pii"))


@query("pii_detect", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{kind}'" for w, kind in analyze.PII.items()) + " END AS kind FROM documents", graph=False)
def _(t):
    return t.documents.select("doc_id", analyze.pii_kind(F.col("text")).alias("kind"))


@query("auth_gap", """, h AS (SELECT node_id, qualified FROM nodes WHERE label = 'part' ORDER BY node_id LIMIT 50),
c AS (SELECT h.node_id, h.qualified, max(CASE WHEN regexp_matches(lower(n.qualified), 'auth|middleware|jwt') THEN 1 ELSE 0 END) AS g FROM h JOIN calls ON to_id = h.node_id JOIN nodes n ON n.node_id = from_id GROUP BY 1, 2)
SELECT node_id, qualified, 'missing-auth' AS category, 'medium' AS severity FROM c WHERE g = 0""")
def _(t):
    nodes = g.nodes(t).withColumns({"concepts": F.when(F.col("label") == "part", F.array(F.lit("endpoint"))), "label": F.when(F.col("label") == "part", "function").otherwise(F.col("label"))})
    return analyze.auth_gaps(nodes, g.calls(t))


def _taint_sql() -> str:
    """For each rule: nodes without its sanitizers, from the targets of tainted arguments, five hops on, to its sinks."""
    parts, union = [], []
    has = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")" if words else "false"
    for k, rule in enumerate(analyze.TAINT_RULES):
        parts.append(f""", open{k} AS (SELECT f.from_id, f.to_id, f.arg FROM uses f LEFT JOIN named a ON a.node_id = f.from_id LEFT JOIN named b ON b.node_id = f.to_id
  WHERE NOT coalesce({has('a.q', rule.sanitizers)}, false) AND NOT coalesce({has('b.q', rule.sanitizers)}, false)),
walk{k} AS (SELECT DISTINCT to_id AS node_id, 0 AS hop FROM open{k} WHERE {has('arg', rule.sources)} UNION SELECT o.to_id, w.hop + 1 FROM walk{k} w JOIN open{k} o ON o.from_id = w.node_id WHERE w.hop < 5)""")
        union.append(f"SELECT node_id, q AS sink, CAST(min(hop) AS INTEGER) AS hop, '{rule.category}' AS category, '{rule.severity}' AS severity FROM walk{k} JOIN named USING (node_id) WHERE {has('q', rule.sinks)} GROUP BY node_id, q")
    return """, named AS (SELECT 'user:' || c_custkey AS node_id, CASE c_custkey % 10 WHEN 0 THEN 'db.Query.' WHEN 1 THEN 'Escape.' WHEN 2 THEN 'os.Open.' WHEN 3 THEN 'exec.Command.' WHEN 4 THEN 'w.Write.' ELSE 'f.' END || c_custkey AS q FROM customer),
uses AS (SELECT from_id, to_id, CASE WHEN mutation_type IS NOT NULL THEN CASE field_path WHEN 'f0' THEN 'req.Body' WHEN 'f1' THEN 'os.Args' WHEN 'f2' THEN 'c.Param' ELSE 'x' END ELSE 'x' END AS arg FROM flows)""" + "".join(parts) + " " + " UNION ALL ".join(union)


@query("taint_findings", _taint_sql())
def _(t):
    of = lambda k: F.try_element_at("props", F.lit(k))
    source = F.when(of("field_path") == "f0", "req.Body").when(of("field_path") == "f1", "os.Args").when(of("field_path") == "f2", "c.Param").otherwise("x")
    users = g.flows(t).withColumn("props", F.create_map(F.lit("arg_expr"), F.when(of("mutation_type").isNotNull(), source).otherwise("x")))
    key = F.col("c_custkey")
    called = F.when(key % 10 == 0, "db.Query.").when(key % 10 == 1, "Escape.").when(key % 10 == 2, "os.Open.").when(key % 10 == 3, "exec.Command.").when(key % 10 == 4, "w.Write.").otherwise("f.")
    nodes = t.customer.select(F.concat(F.lit("user:"), key.cast("string")).alias("node_id"), F.concat(called, key.cast("string")).alias("qualified"))
    return analyze.taint_findings(nodes, users)


# --- history ------------------------------------------------------------------------------------------------------


def _versions(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("hash"), "ts", F.col("event_type").alias("content_hash"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("status"))


CHANGES = """WITH live AS (SELECT user_id AS key, 'c' || event_id AS hash, ts, event_type FROM events WHERE event_type <> 'error'),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY key ORDER BY ts, hash) AS before, row_number() OVER (PARTITION BY key ORDER BY ts, hash) AS rn FROM live),
changes AS (SELECT key, hash, ts, CASE WHEN rn = 1 THEN 'added' ELSE 'modified' END AS change FROM l WHERE rn = 1 OR event_type IS DISTINCT FROM before)
"""


@query("temporal_added_modified", CHANGES + "SELECT key, hash, change FROM changes", graph=False)
def _(t):
    return analyze.index_commits(_versions(t)).select("key", "hash", "change")


@query("node_history", CHANGES + "SELECT key, arg_min(hash, ts) AS introduced_commit, arg_max(hash, ts) AS last_modified_commit, count(*) AS n_changes FROM changes GROUP BY key", graph=False)
def _(t):
    return analyze.node_history(analyze.index_commits(_versions(t))).select("key", "introduced_commit", "last_modified_commit", "n_changes")


@query("edges_introduced", """, e AS (SELECT DISTINCT from_id, to_id, field_path AS introduced_commit FROM flows), r AS (SELECT *, row_number() OVER (ORDER BY from_id, to_id) AS rn FROM e WHERE introduced_commit = 'f1') SELECT from_id, to_id FROM r WHERE rn <= 100""")
def _(t):
    edges = g.flows(t).select("label", "from_id", "to_id", F.try_element_at("props", F.lit("field_path")).alias("introduced_commit")).distinct()
    return analyze.edges_introduced(edges, "f1").select("from_id", "to_id")


@query("suspect_score", """SELECT 'c' || event_id AS hash, round(least(1.0, 0.5 + CASE WHEN d < 1 THEN 0.3 WHEN d < 7 THEN 0.2 WHEN d < 30 THEN 0.1 ELSE 0 END + 0.4 * (event_type = 'error')::INT + 0.2 * CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS score
  FROM (SELECT *, epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 86400 AS d FROM events)""", graph=False)
def _(t):
    name = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    chains = t.events.where("event_type = 'error'").select(name.alias("introduced_commit"), name.alias("last_modified_commit"))
    moved = t.events.where("event_type = 'click'").select(name.alias("last_modified_commit"))
    return analyze.suspect_scores(t.events.select(name.alias("hash"), "ts"), chains, moved, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


# --- memory -------------------------------------------------------------------------------------------------------


def _turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.lit("session").alias("tier"), F.col("turn").alias("created_at"), F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 6, "0"), "role").alias("memory_id"), F.col("text").alias("content"), text.token_estimate(F.coalesce("text", F.lit(""))).alias("token_count"))


BUDGET = "WITH m AS (SELECT conv_id AS session_id, turn, role, CAST(floor(octet_length(encode(coalesce(text, ''))) / 4) AS INTEGER) AS token_count FROM conversations), r AS (SELECT *, coalesce(sum(token_count) OVER (PARTITION BY session_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m) "


@query("session_context_budget", BUDGET + "SELECT session_id, turn AS created_at, token_count FROM r WHERE used < 300", graph=False)
def _(t):
    return memory.session_context(_turns(t), 300).select("session_id", "created_at", "token_count")


@query("token_totals", BUDGET + "SELECT session_id, CAST(sum(token_count) AS BIGINT) AS tokens FROM m GROUP BY session_id", graph=False)
def _(t):
    return memory.token_totals(_turns(t))


@query("turn_truncate", """SELECT conv_id, turn, CASE WHEN strlen(text) <= 200 THEN text ELSE (SELECT string_agg(c, '' ORDER BY i) FROM (SELECT i, c, sum(strlen(c)) OVER (ORDER BY i) AS upto FROM (SELECT unnest(range(1, least(length(text), 200) + 1)) AS i, substr(text, i, 1) AS c)) WHERE upto <= 200) || '...' END AS kept FROM conversations""", graph=False)
def _(t):
    return t.conversations.select("conv_id", "turn", memory.truncated_turn(F.col("text")).alias("kept"))


WORDS = "list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: octet_length(encode(w)) > 2))"
PAIRS = f"""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id AS entry, 'Handler ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' does not check' ELSE ' checks' END || ' the key k' || event_id % 3 AS content FROM events),
s AS (SELECT *, {WORDS} AS w FROM e), p AS (SELECT a.user_id, a.day, a.entry AS a, b.entry AS b, a.content AS ta, b.content AS tb, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.entry < b.entry),
j AS (SELECT *, i / (n + m - i) AS similarity FROM p) """


def _evidence(t: Tables) -> DataFrame:
    says = F.when(F.col("event_id") % 2 == 0, " does not check").otherwise(" checks")
    content = F.concat(F.lit("Handler "), F.col("event_type"), says, F.lit(" the key k"), (F.col("event_id") % 3).cast("string"))
    return t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("entry"), content.alias("content"), F.lit(0.9).alias("relevance"))


@query("jaccard_dedup", PAIRS + "SELECT user_id, day, a, b, round(similarity, 6) AS similarity FROM j WHERE similarity > 0.4", graph=False)
def _(t):
    return memory.similar_pairs(_evidence(t), 0.4, ["user_id", "day"]).select("user_id", "day", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("contradictions", PAIRS + "SELECT user_id, day, a, b FROM j WHERE similarity > 0.3 AND (" + " OR ".join(f"contains(lower(ta), '{n}') <> contains(lower(tb), '{n}')" for n in memory.NEGATIONS) + ")", graph=False)
def _(t):
    return memory.contradictions(_evidence(t), ["user_id", "day"])


@query("evidence_priority", """WITH e AS (SELECT doc_id, least(greatest(l.quality * 1.2, 0), 1) AS rel, CASE source WHEN 'src1' THEN 0.7 ELSE 0.8 END AS cap, toxic FROM documents JOIN labels l USING (doc_id))
SELECT doc_id, round(0.3 * least(rel, 0.5) + 0.3 * least(0.9, cap) + 0.2 * 0.4 + 0.2 * toxic, 6) AS priority FROM e""", graph=False)
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", F.least(memory.clamp(F.col("quality") * 1.2), F.lit(0.5)).alias("relevance"), F.least(F.lit(0.9), memory.reliability(F.when(F.col("source") == "src1", "search:1").otherwise("other"))).alias("confidence"), F.lit(0.4).alias("novelty"), memory.clamp(F.col("toxic").cast("double")).alias("actionability"))
    return rows.select("doc_id", F.round(memory.priority(), 6).alias("priority"))


# --- sync, store ----------------------------------------------------------------------------------------------------


def _set_hash_sql(table: str, columns: list[str]) -> str:
    parts = ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    sums = " || ':' || ".join(f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR)" for k in range(4))
    return f"(SELECT sha256(count(*) || ':' || {sums}) FROM (SELECT sha256(concat_ws('|', {parts})) AS h FROM {table}))"


@query("bundle_manifest", " SELECT 'all' AS repo_slug, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM calls) AS edge_count, sha256("
       + _set_hash_sql("nodes", ["node_id", "label", "qualified", "file_path"]) + " || " + _set_hash_sql("(SELECT 'calls' AS label, from_id, to_id FROM calls)", ["label", "from_id", "to_id"]) + ") AS hash")
def _(t):
    return sync.manifest(g.nodes(t), g.calls(t), "all")


@query("import_merge", """WITH a AS (SELECT c_custkey AS node_id, c_mktsegment AS content_hash, c_acctbal AS at FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS content_hash, 5000.0 AS at FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.node_id IS NULL OR (b.node_id IS NOT NULL AND a.content_hash <> b.content_hash AND b.at > a.at) THEN b.content_hash ELSE a.content_hash END AS content_hash,
  CASE WHEN b.node_id IS NULL THEN 'local' WHEN a.node_id IS NULL THEN 'inserted' WHEN a.content_hash = b.content_hash THEN 'unchanged' WHEN b.at > a.at THEN 'updated' ELSE 'older' END AS action FROM a FULL JOIN b ON a.node_id = b.node_id""", graph=False)
def _(t):
    key = F.col("c_custkey")
    a = t.customer.where(key % 3 != 0).select(key.alias("node_id"), F.col("c_mktsegment").alias("content_hash"), F.col("c_acctbal").alias("last_modified_at"))
    b = t.customer.where(key % 5 != 0).select(key.alias("node_id"), F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("NEW").alias("content_hash"), F.lit(5000.0).alias("last_modified_at"))
    return sync.merge_import(a, b, ["node_id"]).select("node_id", "content_hash", "action")


@query("stale_cleanup", " SELECT node_id FROM nodes WHERE file_path NOT IN (SELECT DISTINCT r_name || '/' || n_name FROM place) AND file_path <> ''")
def _(t):
    disk = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("file_path"))
    return store.stale_nodes(g.nodes(t), disk).select("node_id")


@query("cascade_delete", " SELECT from_id, to_id FROM calls WHERE from_id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size < 25) AND to_id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size < 25)")
def _(t):
    gone = t.part.where("p_size < 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"))
    return store.cascade(g.nodes(t), g.calls(t), gone)[1].select("from_id", "to_id")


@query("incremental_skip", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1", graph=False)
def _(t):
    files = t.documents.select(F.lit("r").alias("repo_slug"), F.col("doc_id").cast("string").alias("file_path"), F.lit("1").alias("content_hash"), "doc_id")
    stored = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).select(F.lit("r").alias("repo_slug"), F.col("doc_id").cast("string").alias("file_path"), F.col("quality").cast("string").alias("content_hash"))
    return store.changed_files(files, stored).select("doc_id")


@query("upsert_nodes", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS state FROM part", graph=False)
def _(t):
    old = t.part.select("p_partkey", F.lit("old").alias("state"))
    return store.upsert(old, t.part.where("p_size > 25").select("p_partkey", F.lit("new").alias("state")), ["p_partkey"])


@query("concept_search", "SELECT p_partkey AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_type IN ('ECONOMY', 'SMALL')) WHERE rn <= 20", graph=False)
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("label"), F.array("p_type").alias("concepts"))
    return store.concept_search(nodes, ["ECONOMY", "SMALL"], 20).select("node_id")


@query("changefeed_since", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 1000", graph=False)
def _(t):
    return store.changes_since(t.events, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 1000, ("ts", "event_id")).select("event_id", "ts")


@query("language_detect", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'gomod' END AS language FROM pages", graph=False)
def _(t):
    k = F.col("page_id") % 5
    path = F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.when(k == 0, ".go").when(k == 1, ".PY").when(k == 2, ".tsx").when(k == 3, "/go.mod").otherwise(".txt"))
    return t.pages.select("page_id", paths.language_of(path).alias("language"))


@query("remote_identity", "SELECT page_id, 'https://h.example/' || page_id || '/repo' AS remote_url, page_id || '/repo' AS slug FROM pages", graph=False)
def _(t):
    key = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("git@h.example:"), key, F.lit("/repo.git"))).otherwise(F.concat(F.lit("https://h.example/"), key, F.lit("/repo.git")))
    return t.pages.select("page_id", paths.remote_url(raw).alias("remote_url"), paths.remote_slug(raw).alias("slug"))


# --- windows and grouping, beyond the graph -------------------------------------------------------------------------


@query("ext_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", graph=False)
def _(t):
    return changefeed.tumbling(t.events, "1 hour", ["event_type"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_session_window", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""", graph=False)
def _(t):
    return changefeed.sessions(t.events, "6 hours", ["user_id"]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", graph=False)
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_cube", "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)", graph=False)
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("ext_setops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0", graph=False)
def _(t):
    both = t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))
    return both.exceptAll(t.nation.where("n_regionkey = 0").select("n_nationkey"))


# --- listings, notations and small rules ------------------------------------------------------------------------------


@query("list_files_limit", " SELECT DISTINCT file_path FROM nodes WHERE starts_with(file_path, 'parts/') ORDER BY file_path LIMIT 10")
def _(t):
    return store.list_files(g.nodes(t), "parts/", 10)[0]


@query("graph_snapshot", """, light AS (SELECT node_id, label FROM nodes ORDER BY node_id LIMIT 2000) SELECT from_id, to_id FROM calls WHERE from_id IN (SELECT node_id FROM light) AND to_id IN (SELECT node_id FROM light)""")
def _(t):
    return store.snapshot(g.nodes(t), g.calls(t))[1].select("from_id", "to_id")


@query("scan_edges", " SELECT 'calls' AS label, from_id, to_id FROM calls UNION ALL SELECT 'tests', from_id, to_id FROM tests")
def _(t):
    edges = g.calls(t).unionByName(g.tests(t)).unionByName(g.defines(t))
    return store.scan_edges(edges, ["calls", "tests"]).select("label", "from_id", "to_id")


@query("merge_update", "SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END, c_mktsegment) AS c_mktsegment FROM customer", graph=False)
def _(t):
    changes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"))
    return store.merge_update(t.customer.select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])


@query("numeric_props", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) AS from_line FROM events", graph=False)
def _(t):
    from graphloom import schema

    edges = t.events.select("event_id", F.create_map(F.lit("from_line"), F.col("props")).alias("props"))
    return schema.numeric_props(edges).select("event_id", "from_line")


@query("reembed_set", " SELECT node_id FROM nodes WHERE label = 'nation' UNION SELECT from_id FROM defines UNION SELECT to_id FROM defines")
def _(t):
    return search.to_reembed(store.scan_nodes(g.nodes(t), labels=["nation"]), g.defines(t))


@query("plan_counts", " SELECT 'label' AS kind, label AS value, count(*) AS n FROM nodes GROUP BY label")
def _(t):
    from graphloom.engine import plan_counts

    return plan_counts(g.nodes(t).withColumn("language", F.lit(None).cast("string")), g.calls(t))


@query("temporal_range", """, v AS (SELECT user_id AS node_id, 'u' || user_id % 3 AS label, min(ts) AS lo, max(ts) AS hi, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS b FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hi, node_id) AS rn FROM v WHERE hi >= TIMESTAMP '2024-01-05 00:00:00' AND hi <= TIMESTAMP '2024-01-30 00:00:00') SELECT node_id, label, CASE WHEN a = b THEN 'added' ELSE 'modified' END AS change FROM r WHERE rn <= 100""")
def _(t):
    nodes = t.events.groupBy(F.col("user_id").alias("node_id")).agg(F.min_by("event_id", "ts").alias("introduced_commit"), F.max_by("event_id", "ts").alias("last_modified_commit"), F.max("ts").alias("last_modified_at"))
    nodes = nodes.withColumn("label", F.concat(F.lit("u"), (F.col("node_id") % 3).cast("string")))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return analyze.temporal_range(nodes, at("2024-01-05 00:00:00"), at("2024-01-30 00:00:00")).select("node_id", "label", "change")


@query("severity_floor", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' ELSE 'high' END AS severity FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", graph=False)
def _(t):
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return analyze.at_least(t.orders.select("o_orderkey", level.alias("severity")), "high")


@query("delta_sync", "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 OR c_custkey % 5 = 0)", graph=False)
def _(t):
    local = t.customer.select("c_custkey", F.col("c_mktsegment").alias("content_hash"))
    known = local.where((F.col("c_custkey") % 3 == 0) | (F.col("c_custkey") % 5 == 0))
    return sync.delta(local, known, ["c_custkey"]).select("c_custkey")


@query("needs_summary", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND n_chars >= 50 AND lang <> 'de'", graph=False)
def _(t):
    name = F.when(F.col("lang") == "de", "TestX").otherwise("Do")
    return t.documents.where(search.needs_summary(F.lit("function"), F.lit(None).cast("string"), F.lit(""), F.col("text"), name, F.lit(0), F.col("n_chars"))).select("doc_id")


@query("log_parse", "SELECT CAST(event_id AS VARCHAR) AS hash, 'user ' || user_id AS author, event_type || '|' || value AS message FROM events", graph=False)
def _(t):
    from graphloom.sources import gitlog

    line = F.concat_ws("|", F.col("event_id").cast("string"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("1700000000"), F.concat_ws("|", "event_type", F.col("value").cast("string")))
    return gitlog.parse_log(t.events.select(line.alias("value"))).select("hash", "author", "message")


@query("numstat_parse", "SELECT 'x/b' || p_partkey || '/f.go' AS path, CAST(p_size AS INTEGER) AS additions, CAST(p_partkey % 2 AS INTEGER) AS deletions, CASE WHEN p_size > 0 AND p_partkey % 2 = 0 THEN 'added' ELSE 'modified' END AS status FROM part", graph=False)
def _(t):
    from graphloom.sources import gitlog

    line = F.concat_ws("\t", F.col("p_size").cast("string"), (F.col("p_partkey") % 2).cast("string"), F.concat(F.lit("x/{a => b"), F.col("p_partkey").cast("string"), F.lit("}/f.go")))
    return gitlog.parse_numstat(t.part.select(line.alias("value")))


@query("line_excerpt", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:4], chr(10)) AS excerpt FROM documents WHERE text IS NOT NULL", graph=False)
def _(t):
    return t.documents.where("text is not null").select("doc_id", text.excerpt(F.col("text"), F.lit(10), F.lit(10)).alias("excerpt"))


@query("convergence_gates", """SELECT conv_id AS session, count(*) >= 3 AND count(*) FILTER (role = 'system') = 0 AS converged FROM conversations GROUP BY conv_id""", graph=False)
def _(t):
    n = lambda c: F.count_if(c)
    state = t.conversations.groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("delegations"), F.lit(5).alias("high_priority"), F.lit(0).alias("open_high"), F.lit(1).alias("last_novel"), F.lit(0).alias("previous_novel"), F.lit(0).alias("hypotheses"), F.lit(0).alias("concluded"), n(F.col("role") == "system").alias("unresolved"))
    return memory.convergence(state).select("session", "converged")


@query("ext_sliding", "SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) GROUP BY window_start", graph=False)
def _(t):
    return changefeed.sliding(t.events, "1 hour", "30 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
