"""Parts of exchanges grow with the rows."""

from pyspark.sql import functions as F

from graphloom.functions import joins
from graphloom.operators import analyze, link, search, store, tables, textindex, traverse
from graphloom.plans import driver_graph as g

SF = "/root/testdata/sf0.001"


def test_edges_are_made_in_as_many_parts_as_the_rows_need(spark, monkeypatch):
    t = g.Tables(spark, SF)
    want = sorted((r.from_id, r.to_id) for r in g.tests(t).unionByName(g.calls(t)).collect())
    monkeypatch.setattr(joins, "ROWS_A_TASK", 500)
    t = g.Tables(spark, SF)
    assert g.tests(t).rdd.getNumPartitions() == -(-t.rows("lineitem") // 500) > 4
    assert sorted((r.from_id, r.to_id) for r in g.tests(t).unionByName(g.calls(t)).collect()) == want


def test_a_large_label_is_written_by_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    s = store.GraphStore(spark, str(tmp_path / "store"))
    edges = [("calls", f"a{k % 7}", f"b{k}", f"r{k % 10 // 9}") for k in range(1000)]
    frame = spark.createDataFrame(edges, "label string, from_id string, to_id string, repo_slug string")
    s.put_edges(frame)
    files = lambda: {r[0]: r[1] for r in s.edges.groupBy(F.input_file_name()).count().collect()}
    assert len(files()) >= 10 and max(files().values()) <= 200
    s.delete(spark.createDataFrame([("r0", "a3")], "repo_slug string, node_id string"))
    s.put_edges(frame.where("to_id = 'b5'"))
    want = sorted([e for e in edges if e[1] != "a3" or e[3] != "r0"] + [e for e in edges if e[2] == "b5"])
    assert sorted(tuple(r) for r in s.edges.select("label", "from_id", "to_id", "repo_slug").collect()) == want
    assert max(files().values()) <= 200


def test_edges_of_a_repository_are_compared_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 50)
    parts, dealt = [], store.dealt
    monkeypatch.setattr(store, "dealt", lambda df, rows, *keys: parts.append(dealt(df, rows, *keys).rdd.getNumPartitions()) or dealt(df, rows, *keys))
    s = store.GraphStore(spark, str(tmp_path / "store"))
    frame = lambda ks: spark.createDataFrame([("calls", f"a{k}", f"b{k}", "r") for k in ks], "label string, from_id string, to_id string, repo_slug string")
    s.put_edges(frame(range(400)))
    s.replace_edges("r", frame(range(100, 450)))
    assert min(parts) == 8
    assert sorted(int(r.to_id[1:]) for r in s.edges.collect()) == list(range(100, 450))
    log = {(r.op, int(r.id[1:])) for r in s.log().collect()}
    assert log == {("put", k) for k in range(450)} | {("delete", k) for k in range(100)}


def test_an_index_makes_tokens_once_and_moves_none_to_count_them(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = [(1, "b a b b"), (2, ""), (3, None), (4, "a")]
    docs = spark.createDataFrame(rows, "id long, words string").coalesce(1)

    def note(text):
        seen.add(1)
        return text.split() if text is not None else None

    tokens = F.udf(note, "array<string>").asNondeterministic()(F.col("words"))
    found = search.postings(docs, "id", {"every": tokens})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.term, r.tf, r.length, r.head) for r in found.collect()) == [(1, "a", 1, 4, True), (1, "b", 3, 4, False), (4, "a", 1, 1, True)]
    seen.value = 0
    textindex.build(docs, "id", {"every": tokens}, str(tmp_path / "index"))
    assert seen.value == len(rows)


def test_postings_of_a_term_are_dealt_to_its_blocks_hot_or_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    monkeypatch.setattr(textindex, "HOT", 50)
    docs = spark.range(200).select(F.col("id"), F.array(F.lit("hot"), F.when(F.col("id") % 5 == 0, "cold").otherwise("rest")).alias("t"))
    index = textindex.build(docs, "id", {"every": F.col("t")}, str(tmp_path / "index"))
    rows = index.table("postings").select("term", "block", F.explode("ids").alias("id"), F.xxhash64("id").alias("h")).collect()
    parts = {(r.term): r.parts for r in index.table("dictionary").collect()}
    assert parts == {"hot": 25, "cold": 5, "rest": 20}
    assert len(rows) == 400 and all(r.block == r.h % parts[r.term] for r in rows)


def test_an_edge_moves_once_to_each_end_and_gives_the_same_neighbours(spark):
    nodes = [("a", "A"), ("b", "B"), ("b", "B2"), ("c", None), ("d", "D"), ("e", "E")]
    of = ["a", "b", "c", "c", "x", "e"]
    props = {"field_path": "p", "arg_expr": "q", "field": "f"}
    ends = [("a", "b"), ("b", "a"), ("c", "a"), ("a", "c"), ("x", "d"), ("d", "x"), ("a", "a"), ("b", "b"), ("a", "b"), (None, "a"), ("a", None), ("z", "e"), ("e", "d")]
    edges = [(label, a, b, p) for label in ("calls", "data_flow", "reads", "writes", "other") for a, b in ends for p in (props, None)]
    kinds = [("callees", "calls", 1, 2, None), ("callers", "calls", 2, 1, None), ("sinks", "data_flow", 1, 2, "field_path"), ("sources", "data_flow", 2, 1, "arg_expr"), ("reads", "reads", 1, 2, "field"), ("writes", "writes", 1, 2, "field")]
    want = [(e[here], kind, e[there], name, (e[3] or {}).get(prop)) for e in edges for kind, label, here, there, prop in kinds if e[0] == label and e[here] in of for node, name in nodes if node == e[there] and name]
    found = traverse.neighbour_rows(
        spark.createDataFrame(edges, "label string, from_id string, to_id string, props map<string,string>"), spark.createDataFrame(nodes, "node_id string, qualified string"), spark.createDataFrame([(x,) for x in of], "node_id string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # edges meet their ends before each becomes two rows


def test_names_and_sites_are_looked_up_for_the_nodes_of_a_small_search_alone(spark, monkeypatch):
    edges = spark.createDataFrame([("calls", f"n{k}", f"n{k + 1}", f"n{k}.go:{9 - s}") for k in range(40) for s in range(2)], "label string, from_id string, to_id string, call_site string")
    nodes = spark.createDataFrame([(f"n{k}", f"q{k // 2}" if k % 3 else None) for k in range(40)], "node_id string, qualified string")
    seeds = spark.createDataFrame([("s", "n1")], "seed_id string, node_id string")
    want = [("n2", 1, "q1", "n2.go:8"), ("n3", 2, None, "n3.go:8"), ("n4", 3, "q2", "n4.go:8"), ("n6", 5, None, "n6.go:8")]
    for most, moved in ((200_000, 2), (0, 0)):
        monkeypatch.setattr(analyze, "SENT_FRONTIER", most)
        found = analyze.trace(seeds, edges, nodes, sites=True)
        assert sorted((r.node_id, r.hop, r.qualified, r.caller_site) for r in found.collect()) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == moved


def test_many_seeds_are_searched_as_sets_with_the_same_rows(spark):
    """Of a search for hops alone from many seeds no row of a seed and a node is moved; before, each level moved all of them."""
    edges = [(f"n{k % 90}", f"n{(k * k + 7 * k) % 100}") for k in range(300)] + [("n1", "n1"), (None, "n2"), ("n3", None), ("n4", "n5"), ("n4", "n5")]
    rows = spark.createDataFrame([("calls", a, b) for a, b in edges], "label string, from_id string, to_id string")
    starts = [(f"n{k}", f"n{k}") for k in range(100)] + [("n0", "n50"), (None, "n7"), ("x", "nowhere"), ("y", None)]
    seeds = spark.createDataFrame(starts + starts[:3], "seed_id string, node_id string")
    found = traverse.traverse(seeds, rows, ["calls"], "forward", 4, via=False)
    ahead, want = {}, set()
    for a, b in edges:
        if a is not None and b is not None:
            ahead.setdefault(a, set()).add(b)
    for seed in {s for s, _ in starts}:
        seen = level = {n for s, n in starts if s == seed}
        for hop in range(1, 5):
            level = {b for a in level for b in ahead.get(a, ())} - seen
            seen = seen | level
            want |= {(seed, n, hop) for n in level}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Aggregate [seed_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_interface_division_moves_no_row_of_a_type_and_an_interface(spark, monkeypatch):
    """Sets and interfaces meet in cells; before, pairs, and methods for each interface and block, were shuffled."""
    import random

    monkeypatch.setattr(link, "CELL_IFACES", 5)
    monkeypatch.setattr(link, "CELL_BLOCKS", 1)
    rng = random.Random(3)
    shape = lambda: (f"m{rng.randrange(4)}", rng.choice(["()", "(x int)", None]))
    kinds = {f"t{k}": [(*shape(), "T") for _ in range(rng.randrange(1, 5))] for k in range(1100)}
    kinds |= {f"i{k}": [(*shape(), "") for _ in range(rng.randrange(1, 4))] for k in range(12)}
    kinds |= {"odd": [("none", "()", ""), ("m1", "()", "")], "both": [("m1", "()", "T"), ("m1", "()", "")], "empty": [("", "()", "")]}
    rows = [(name, "class", [{"name": n, "signature": s, "receiver": r} for n, s, r in ms]) for name, ms in kinds.items()]
    nodes = spark.createDataFrame(rows, "node_id string, label string, methods array<struct<name:string,signature:string,receiver:string>>")
    want = set()
    for iface, asked in kinds.items():
        asked = [(n, s or "") for n, s, r in asked if r == "" and n]
        wants = {n: {s for m, s in asked if m == n} for n, _ in asked}
        for name, ms in kinds.items():
            has = [(n, s or "") for n, s, r in ms if r]
            if wants and name != iface and all(any(n == m and ("" in w or s in w) for m, s in has) for n, w in wants.items()):
                want.add((name, iface))
    found = link.implements_edges(nodes)
    got = [(r.from_id, r.to_id) for r in found.collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("MapInArrow")[0] for x in ("Join", "Aggregate", "Repartition"))
