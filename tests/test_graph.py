import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analyze, derive, link, ranges, store, traverse

NODE = "node_id string, label string, name string, qualified string, file_path string, start_line int, end_line int"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def edges_of(spark, pairs, label="calls"):
    return frame(spark, [(label, a, b, f"{a}.go:1", None) for a, b in pairs], "label string, from_id string, to_id string, call_site string, props map<string,string>")


def nodes_of(spark, names, label="function"):
    return frame(spark, [(n, label, n, f"p.{n}", f"{n}.go", 0, 0) for n in names], NODE)


def python_bfs(pairs, start, depth):
    seen, out, queue = {start}, {}, deque([(start, 0)])
    while queue:
        x, d = queue.popleft()
        for a, b in pairs:
            if a == x and b not in seen and d < depth:
                seen.add(b)
                out[b] = d + 1
                queue.append((b, d + 1))
    return out


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_bfs_equals_plain_bfs_on_random_cyclic_graphs(spark, depth):
    rng = random.Random(depth)
    names = [f"n{k}" for k in range(25)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    seeds = frame(spark, [(s, s) for s in names[:4]], "seed_id string, node_id string")
    got = traverse.traverse(seeds, edges_of(spark, pairs), ["calls"], "forward", depth).collect()
    assert {(r.seed_id, r.node_id, r.hop) for r in got} == {(s, n, h) for s in names[:4] for n, h in python_bfs(pairs, s, depth).items()}
    back = traverse.traverse(seeds, edges_of(spark, [(b, a) for a, b in pairs]), ["calls"], "reverse", depth).collect()
    assert {tuple(r)[:3] for r in back} == {tuple(r)[:3] for r in got}
    assert all((r.parent_id, r.node_id) in set(pairs) for r in got)


def test_labels_alone_and_mixed(spark):
    edges = edges_of(spark, [("a", "b")]).unionByName(edges_of(spark, [("b", "c"), ("a", "b")], "tests"))
    seeds = frame(spark, [("s", "a")], "seed_id string, node_id string")
    alone = {(r.node_id, r.hop, r.label) for r in traverse.traverse(seeds, edges, ["calls", "tests"]).collect()}
    assert alone == {("b", 1, "calls"), ("c", 2, "tests")}
    assert {(r.node_id, r.hop) for r in traverse.traverse(seeds, edges, ["calls", "tests"], mode="mixed").collect()} == {("b", 1), ("c", 2)}
    only = traverse.traverse(seeds, edges, ["calls", "tests"], nodes=nodes_of(spark, "bc", "class"), target_labels=["function"])
    assert only.count() == 0
    assert traverse.traverse(seeds.where("false"), edges, ["calls"]).collect() == []


def test_blast_default_depth_cap_and_order(spark):
    chain = [(f"n{k + 1}", f"n{k}") for k in range(9)]
    nodes = nodes_of(spark, [f"n{k}" for k in range(10)])
    seed = frame(spark, [("n0",)], "node_id string")
    assert [r.hop for r in analyze.blast_radius(seed, edges_of(spark, chain), nodes).collect()] == [1, 2, 3]
    assert len(analyze.blast_radius(seed, edges_of(spark, chain), nodes, max_depth=50).collect()) == 5
    both = analyze.blast_radius(seed, edges_of(spark, [("z", "n0"), ("a", "n0")]), nodes_of(spark, ["a", "z", "n0"]))
    assert [(r.node_id, r.module) for r in both.collect()] == [("a", "p"), ("z", "p")]


def test_neighbourhood(spark):
    edges = edges_of(spark, [("a", "x"), ("b", "x"), ("x", "c"), ("x", "ghost")]).unionByName(
        frame(spark, [("data_flow", "x", "c", None, {"field_path": "f"}), ("reads", "x", "c", None, {"field": "c.v"})], "label string, from_id string, to_id string, call_site string, props map<string,string>"))
    row = traverse.neighbours(edges, nodes_of(spark, ["a", "b", "c", "x"]), frame(spark, [("x",), ("a",)], "node_id string")).where("node_id = 'x'").first()
    assert [c.other_id for c in row.callers] == ["a", "b"] and [c.other_id for c in row.callees] == ["c"]
    assert [(c.other_id, c.detail) for c in row.sinks] == [("c", "f")] and [c.detail for c in row.reads] == ["c.v"] and row.writes == [] and row.sources == []


def test_field_flow_emits_edges_into_visited_nodes(spark):
    rows = [("data_flow", "a", "b", None, {"field_path": "f"}), ("data_flow", "b", "a", None, {"field_path": "f", "mutation_type": "assignment"}), ("data_flow", "b", "c", None, {"field_path": "g"}), ("writes", "c", "d", None, {"field": "g"})]
    edges = frame(spark, rows, "label string, from_id string, to_id string, call_site string, props map<string,string>")
    seed = frame(spark, [("a",)], "node_id string")
    for depth in (3, 10):
        got = {(r.depth, r.from_id, r.to_id) for r in traverse.field_flow_edges(seed, edges, None, depth, ("data_flow", "writes")).collect()}
        assert got == {(1, "a", "b"), (2, "b", "a"), (2, "b", "c"), (3, "c", "d")}
    chains = {r.field_path: (r.n_mutations, r.taint_node) for r in analyze.field_flow_chains(seed, edges).collect()}
    assert chains == {"f": (1, "a"), "g": (0, None)}
    assert {r.field_path for r in analyze.field_flow_chains(seed, edges, only_mutated=True).collect()} == {"f"}


def test_degrees(spark):
    got = {r.node_id: tuple(r)[1:] for r in derive.degrees(nodes_of(spark, "abc"), edges_of(spark, [("a", "b"), ("a", "b")])).collect()}
    assert got == {"a": (0, 2, 2, False, True), "b": (2, 0, 2, True, False), "c": (0, 0, 0, True, False)}


DIFF = "path string, old_path string, status string, patch string"


def test_diff_impact(spark):
    nodes = frame(spark, [
        ("login", "function", "Login", "pkg.Login", "pkg/auth.go", 1, 10), ("h", "function", "Handler", "pkg.Handler", "pkg/h.go", 1, 9), ("t", "function", "TestH", "pkg.TestH", "pkg/h_test.go", 1, 9),
        ("none", "function", "NoLines", "pkg.NoLines", "pkg/auth.go", 0, 0), ("far", "function", "Far", "pkg.Far", "pkg/auth.go", 50, 0), ("old", "function", "Old", "pkg.Old", "pkg/old.go", 1, 2),
    ], NODE)
    edges = edges_of(spark, [("h", "login"), ("t", "h")])
    diffs = frame(spark, [("pkg/auth.go", None, "modified", "@@ -3,5 +3,5 @@"), ("pkg/gone.go", "pkg/old.go", "deleted", "")], DIFF)
    got = {(r.node_id, r.hop, r.role) for r in analyze.diff_impact(diffs, edges, nodes).collect()}
    assert got == {("login", 0, "changed"), ("none", 0, "changed"), ("old", 0, "changed"), ("h", 1, "affected"), ("t", 2, "test")}
    edge = frame(spark, [("pkg/auth.go", None, "renamed", "@@ -1 +50,1 @@")], DIFF)
    assert {r.node_id for r in ranges.overlapping(nodes, analyze.diff_ranges(edge)).collect()} == {"far", "none"}


def test_call_resolution_and_labels(spark):
    nodes = frame(spark, [
        ("function:app.Foo", "function", "Foo", "app.Foo", "foo.go", 0, 0), ("function:app.Bar", "function", "Bar", "app.Bar", "bar.go", 0, 0), ("function:x.Baz", "function", "Baz", "x.Baz", "x.go", 0, 0),
        ("function:y.Two", "function", "Two", "y.Two", "y.go", 0, 0), ("function:z.Two", "function", "Two", "z.Two", "z_test.go", 0, 0), ("function:q.T", "function", "T", "q.T", "q_test.go", 0, 0), ("function:r.T", "function", "T", "r.T", "r_test.go", 0, 0),
    ], NODE)
    raw = ["Bar", "DoesNotExist", "s.Baz", "Two", "T", "function:app.Bar", "app.Bar"]
    edges = edges_of(spark, [("function:app.Foo", t) for t in raw])
    got = {r.to_id: (r.resolved_id, r.strategy) for r in link.resolve_targets(edges, nodes).collect()}
    assert got == {"Bar": ("function:app.Bar", "package"), "DoesNotExist": (None, None), "s.Baz": ("function:x.Baz", "suffix"), "Two": ("function:y.Two", "suffix"), "T": (None, None),
                   "function:app.Bar": ("function:app.Bar", "id"), "app.Bar": ("function:app.Bar", "exact")}
    linked = link.CallLinker().link(edges, nodes)
    stats = link.link_stats(linked).first()
    assert (stats.processed, stats.resolved, stats.unresolved) == (7, 5, 2)
    assert "DoesNotExist" in {r.to_id for r in linked.where("not resolved").collect()}


@pytest.mark.parametrize("name, path, want", [
    ("Helper", "foo_test.go", "tests"), ("TestThing", "x.go", "tests"), ("BenchmarkX", "x.go", "tests"), *((n, "x.go", "constructs") for n in ("NewServer", "init", "main", "wireDeps", "setupRoutes", "registerHandlers")),
    ("doSomething", "wire.go", "constructs"), ("doSomething", "a/main.go", "constructs"), ("Process", "service.go", "calls"), (None, None, "calls"),
])
def test_call_labels(spark, name, path, want):
    row = frame(spark, [(path, name)], "path string, name string")
    assert row.select(link.call_label(F.col("path"), F.col("name"), F.col("name").isNotNull()).alias("l")).first().l == want


def test_defines_takes_the_longest_owner(spark):
    nodes = frame(spark, [
        ("file:foo", "file", "foo.go", "foo.go", "foo.go", 0, 0), ("module:p", "module", "p", "p", "foo.go", 0, 0), ("class:W", "class", "Widget", "p.Widget", "foo.go", 0, 0),
        ("function:Do", "function", "Do", "p.Widget.Do", "foo.go", 0, 0), ("function:H", "function", "Helper", "p.Helper", "foo.go", 0, 0),
    ], NODE)
    assert {(r.from_id, r.to_id) for r in link.defines_edges(nodes).collect()} == {("file:foo", "class:W"), ("class:W", "function:Do"), ("file:foo", "function:H")}


def test_interface_satisfaction(spark):
    m = lambda name, sig, receiver="": (name, sig, receiver)
    rows = [
        ("i", [m("Run", "Run(ctx context.Context) error")]), ("ok", [m("Run", "Run(ctx context.Context)  error", "*A"), m("Other", "x", "A")]), ("bad", [m("Run", "Run() error", "B")]), ("missing", [m("Stop", "Stop()", "C")]),
        ("generic", [m("Run", "Run[T any](ctx context.Context) error", "D")]), ("empty", []), ("embedded", [m("", "io.Reader")]), ("two", [m("Run", ""), m("Stop", "Stop()")]), ("both", [m("Run", "anything", "E"), m("Stop", "Stop()", "*E")]),
    ]
    nodes = frame(spark, [(k, "class", v) for k, v in rows], "node_id string, label string, methods array<struct<name:string,signature:string,receiver:string>>")
    assert {(r.from_id, r.to_id) for r in link.implements_edges(nodes).collect()} == {("ok", "i"), ("generic", "i"), ("both", "two")}


def test_field_access_linker(spark):
    nodes = frame(spark, [("m", "function", "Do", "p.T.Do", "a.go", 0, 0), ("f", "function", "F", "p.F", "a.go", 0, 0), ("ct", "class", "T", "p.T", "a.go", 0, 0), ("cu", "class", "User", "p.User", "a.go", 0, 0)], NODE)
    edges = frame(spark, [("reads", "m", "t.x"), ("writes", "f", "user.name"), ("reads", "f", "nope.x")], "label string, from_id string, to_id string")
    assert {(r.from_id, r.to_id, r.resolved) for r in link.FieldAccessLinker().link(edges, nodes).collect()} == {("m", "ct", True), ("f", "cu", True), ("f", "nope.x", False)}


def test_tests_subjects_and_interfaces(spark):
    nodes = frame(spark, [("t", "function", "TestA", "p.TestA", "a_test.go", 0, 0), ("a", "function", "A", "p.A", "a.go", 0, 0), ("b", "function", "B", "p.B", "b.go", 0, 0), ("i", "class", "I", "p.I", "i.go", 0, 0), ("c", "class", "C", "p.C", "c.go", 0, 0)], NODE)
    edges = edges_of(spark, [("t", "a")], "tests").unionByName(edges_of(spark, [("a", "b"), ("t", "a")])).unionByName(edges_of(spark, [("c", "i")], "implements")).unionByName(edges_of(spark, [("b", "c")], "constructs"))
    assert [(r.node_id, r.hop) for r in analyze.tests_for(frame(spark, [("a",)], "node_id string"), edges, nodes).collect()] == [("t", 1)]
    assert {(r.node_id, r.hop) for r in analyze.subjects_for(frame(spark, [("t",)], "node_id string"), edges, nodes).collect()} == {("a", 1), ("b", 2)}
    assert {(r.node_id, r.role) for r in analyze.resolve_interface(frame(spark, [("i",)], "node_id string"), edges, nodes, True).collect()} == {("c", "implementation"), ("b", "binding")}


def test_symbol_resolution(spark):
    nodes = nodes_of(spark, ["Handler", "Other"]).unionByName(frame(spark, [("o2", "function", "Other", "q.Other", "o.go", 3, 4)], NODE))
    assert [(r.qualified, r.status) for r in store.resolve_symbol(nodes, "Handler").collect()] == [("p.Handler", "suffix")]
    assert {(r.qualified, r.status) for r in store.resolve_symbol(nodes, "Other").collect()} == {("p.Other", "ambiguous"), ("q.Other", "ambiguous")}
    assert [r.status for r in store.resolve_symbol(nodes, "q.Other").collect()] == ["exact"] and store.resolve_symbol(nodes, "No").collect() == []
    assert store.find_by_qualified(nodes, "Other").count() == 1


def test_taint_is_cut_by_sanitizers(spark):
    rows = [("data_flow", "h", "a", None, {"arg_expr": "req.Body"}), ("data_flow", "a", "q", None, {"arg_expr": "x"}), ("data_flow", "h", "c", None, {"arg_expr": "req.Body"}), ("data_flow", "c", "e", None, {"arg_expr": "x"})]
    edges = frame(spark, rows, "label string, from_id string, to_id string, call_site string, props map<string,string>")
    nodes = frame(spark, [("h", "h"), ("a", "svc.a"), ("q", "db.Query"), ("c", "shellescape"), ("e", "exec.Command")], "node_id string, qualified string")
    assert {(r.sink, r.category, r.hop) for r in analyze.taint_findings(nodes, edges).collect()} == {("db.Query", "sql-injection", 1)}


def test_openapi(spark):
    import json

    rows = [("route", "f", "h1", "a.go:3", {"http_method": "get", "http_path": "/x", "middleware": "auth"}), ("route", "f", "h2", "a.go:4", {"http_method": "post", "http_path": "/x", "middleware": ""})]
    edges = frame(spark, rows, "label string, from_id string, to_id string, call_site string, props map<string,string>")
    doc = json.loads(analyze.openapi(analyze.api_surface(edges, nodes_of(spark, ["h1"]))).first().document)
    assert doc["openapi"] == "3.0.0" and set(doc["paths"]["/x"]) == {"get", "post"} and doc["paths"]["/x"]["get"]["operationId"] == "p.h1"


def test_root_cause(spark):
    rows = [("data_flow", "w", "x", None, {"field_path": "f", "mutation_type": "assignment"})]
    edges = frame(spark, rows, "label string, from_id string, to_id string, call_site string, props map<string,string>")
    nodes = frame(spark, [("x", "c1", "c2"), ("w", "c3", "c3")], "node_id string, introduced_commit string, last_modified_commit string")
    commits = frame(spark, [("c1", "a", "m", "2024-01-01"), ("c3", "b", "n", "2024-02-01"), ("c9", "b", "n", "2024-02-01")], "hash string, author string, message string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = analyze.root_cause(frame(spark, [("x", 1.0)], "node_id string, score double"), edges, nodes, commits, F.to_timestamp(F.lit("2024-02-01 12:00:00"))).collect()
    assert [(r.hash, r.score) for r in got] == [("c3", 1.0), ("c1", 0.5)]


def test_store_round_trip(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.nodes.count() == 0
    nodes = frame(spark, [(n, "function", n, f"batch.{n}", "batch.go", "r") for n in "AB"], "node_id string, label string, name string, qualified string, file_path string, repo_slug string")
    edges = frame(spark, [("calls", "A", "B", "r")], "label string, from_id string, to_id string, repo_slug string")
    s.put_batch(nodes, edges)
    s.put_batch(nodes.where("name = 'A'").withColumn("name", F.lit("A2")), edges)
    assert {(r.node_id, r.name) for r in s.nodes.collect()} == {("A", "A2"), ("B", "B")} and s.edges.count() == 2
    s.put_repo(frame(spark, [("o/r", "https://h/o/r")], "slug string, remote_url string"))
    assert s.find_repo("https://h/o/r").first().slug == "o/r" and [r.slug for r in s.list_repos().collect()] == ["o/r"]
    s.delete(frame(spark, [("r", "B")], "repo_slug string, node_id string"))
    assert [r.node_id for r in s.nodes.collect()] == ["A"] and s.edges.count() == 0
    s.delete_file("r", "batch.go")
    assert s.nodes.count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_a_search_for_hops_alone_finds_the_same_nodes(spark, depth):
    pairs = [(f"n{k}", f"n{(k * 7 + j) % 40}") for k in range(40) for j in (1, 3)]
    edges = edges_of(spark, pairs).unionByName(edges_of(spark, [("n1", "n30"), ("n30", "n2")], "tests"))
    seeds = frame(spark, [("s", "n0"), ("t", "n1"), ("t", "n5")], "seed_id string, node_id string")
    for labels, mode in ((["calls"], "per_label"), (["tests", "calls"], "per_label"), (["tests", "calls"], "mixed")):
        whole = traverse.traverse(seeds, edges, labels, "forward", depth, mode)
        lean = traverse.traverse(seeds, edges, labels, "forward", depth, mode, via=False)
        assert "parent_id" not in lean.columns and "call_site" not in lean.columns
        assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, whole.select(*lean.columns).collect()))


def test_interfaces_meet_types_of_several_blocks(spark):
    shape = "node_id string, label string, methods array<struct<name:string,signature:string,receiver:string>>"
    types = [(f"t{k}", "class", [("Run", "(int)" if k % 2 else "(string)", "T")] + ([("Close", "()", "T")] if k % 3 == 0 else [])) for k in range(1500)]
    ifaces = [("any", "class", [("Run", "", ""), ("Close", "()", "")]), ("odd", "class", [("Run", "(int)", "")]),
              ("either", "class", [("Run", "(int)", ""), ("Run", "(string)", ""), ("Close", "", "")]), ("none", "class", [("Run", "", ""), ("Stop", "", "")]), ("self", "class", [("Run", "(int)", ""), ("Run", "(int)", "S")])]
    plan = link.implements_edges(frame(spark, types + ifaces, shape))
    got = {}
    for r in plan.collect():
        assert r.label == "implements" and r.from_id not in got.setdefault(r.to_id, set())
        got[r.to_id].add(r.from_id)
    thirds, odd = {f"t{k}" for k in range(0, 1500, 3)}, {f"t{k}" for k in range(1, 1500, 2)}
    assert got == {"any": thirds, "either": thirds, "odd": odd | {"self"}, "self": odd}
    assert "array_contains" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no sets of names are compared
