"""Stored indexes, keyed state, Merkle sync, history, range sweeps and similarity classes against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import derive, history, lookup, memory, merkle, ranges, search, sync, textindex
from graphloom.storage import new_folder
from graphloom.streaming import degrees, registry


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


# --- postings ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    docs = []
    for k in range(600):
        words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randint(0, 60))] + ["every"] * rng.randint(1, 3) + ["rare"] * (rng.randint(1, 9) if k % 97 == 0 else 0)
        docs.append((k, " ".join(words), f"title w{k % 7}" if k % 5 else None, "clash", 3))
    docs += [(1000 + k, "rare every copy", "title", "clash", 3) for k in range(300)]
    return spark.createDataFrame(docs, "node_id long, docstring string, name string, term string, level int").repartition(3)


def fields():
    from graphloom.functions import text

    return {"name": text.word_tokens(F.coalesce("name", F.lit(""))), "docstring": text.word_tokens(F.col("docstring"))}


def test_stored_postings_rank_like_a_scan_and_skip_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    monkeypatch.setattr(textindex, "HOT", 100)
    index = textindex.build(corpus, "node_id", fields(), new_folder(spark))
    assert index.table("postings").agg(F.max(F.size("ids"))).first()[0] < 64
    for terms, k in ((["rare", "every"], 10), (["w1", "title", "every", "nothing"], 20), (["every"], 1000), (["rare"], 3), (["nothing"], 5), ([], 5)):
        want = search.bm25_scores(corpus, "node_id", fields(), terms).orderBy(F.desc("score"), "node_id").limit(k)
        got = textindex.load(spark, index.path, "node_id").search(terms, k)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    # the frequent word finds nothing by itself: of its blocks only those that may hold the best of the rare one are read
    seen = []
    monkeypatch.setattr(textindex.TextIndex, "blocks", lambda self, wanted, old=textindex.TextIndex.blocks: seen.append(old(self, wanted)) or seen[-1])
    index.search(["rare", "every"], 3).collect()
    of = lambda frame, term: frame.where(F.col("term") == term).count()
    assert sum(of(x, "every") for x in seen) < of(index.table("postings"), "every") / 2
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "In(term" in plan or "EqualTo(term" in plan


# --- point lookups ----------------------------------------------------------------------------------------------------


def scanned(frame) -> int:
    """Rows that the scan of ``frame`` gave out, from its metrics, after it has run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            found += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.length())]
    return found


def test_lookups_read_few_rows(spark):
    path = new_folder(spark)
    n = 60_000
    nodes = spark.range(n).select(
        F.concat(F.lit("function:"), F.sha2(F.col("id").cast("string"), 256)).alias("node_id"), F.lit("function").alias("label"), F.concat(F.lit("N"), (F.col("id") % 30_000).cast("string")).alias("name"),
        F.concat(F.lit("pkg."), F.sha2((F.col("id") + 7).cast("string"), 256)).alias("qualified"), F.lit("a.go").alias("file_path"),
    )
    lookup.save(nodes, path, row_group=1 << 18, rows_expected=10_000)
    some = nodes.where("name = 'N17'").orderBy("node_id").first()
    one = lookup.by_id(spark, path, [some.node_id, "function:none"])
    assert scanned(one) < n / 5 and [r.name for r in one.collect()] == ["N17"]
    exact = lookup.by_qualified(spark, path, some.qualified)
    assert scanned(exact) < n / 2 and [r.node_id for r in exact.collect()] == [some.node_id]
    assert [r.node_id for r in lookup.find(spark, path, some.qualified).collect()] == [some.node_id]
    assert [r.node_id for r in lookup.find(spark, path, "N17").collect()] == [some.node_id]
    assert lookup.find(spark, path, "no.such").count() == 0


# --- keyed state ------------------------------------------------------------------------------------------------------


def test_entries_are_evicted_by_event_time(spark, tmp_path):
    batches = [
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:01:00"), (None, "2024-01-01 00:02:00"), ("n", None)],
        [("a", "2024-01-01 00:40:00"), ("c", "2024-01-01 00:41:00"), ("c", "2024-01-01 00:40:30")],
        [("d", "2024-01-01 02:00:00")],
        [("b", "2024-01-01 00:01:30"), ("d", "2024-01-01 02:10:00")],  # the first is later than the watermark
    ]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "key string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    out = registry.evicted(stream, "key", "at", 1800)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = [(r.key, str(r.started)[11:], str(r.seen)[11:], r.n) for r in spark.read.schema("key string, started timestamp, seen timestamp, n long").parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [("a", "00:00:00", "00:05:00", 2), ("a", "00:40:00", "00:40:00", 1), ("b", "00:01:00", "00:01:00", 1), ("c", "00:40:30", "00:41:00", 2)]


def test_live_degrees_equal_those_from_scratch(spark, monkeypatch):
    monkeypatch.setattr(degrees, "FOLD_EVERY", 2)
    rng, live, there = random.Random(1), degrees.LiveDegrees(spark, new_folder(spark)), []
    assert live.current().count() == 0
    ddl = "op string, label string, from_id string, to_id string, n int"
    for number in range(5):
        new = [("put", rng.choice(["calls", "calls", "tests"]), f"n{rng.randint(0, 9)}", rng.choice([f"n{rng.randint(0, 9)}", None])) for _ in range(30)]
        old = [there.pop(rng.randrange(len(there))) for _ in range(8)] if there else []
        there += [x[1:] for x in new]
        batch = spark.createDataFrame([(*x, 1) for x in new] + [("delete", *x, 1) for x in old], ddl)
        for _ in range(1 + number % 2):  # a batch that is run again
            live.apply(batch, number)
    nodes = spark.createDataFrame([(f"n{k}", "function") for k in range(10)], "node_id string, label string")
    want = derive.degrees(nodes, spark.createDataFrame(there, "label string, from_id string, to_id string")).where("centrality > 0")
    assert rows(live.current()) == rows(want.select("node_id", "call_count", "callee_count", "centrality"))
    live.apply(batch, 2)  # covered by the base
    assert rows(live.current()) == rows(want.select("node_id", "call_count", "callee_count", "centrality"))


# --- Merkle sync ------------------------------------------------------------------------------------------------------


def test_one_changed_row_moves_one_range(spark):
    local = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(1).alias("node"))
    remote = local.withColumn("content_hash", F.when(F.col("node_id") == "n77", "old").otherwise(F.col("content_hash")))
    levels = merkle.levels_for(5_000_000)
    assert levels == 4 and merkle.levels_for(0) == merkle.levels_for(10) == 1
    mine, theirs = (merkle.tree(x, ["node_id"], ["content_hash"], levels) for x in (local, remote))
    leaves, asked = merkle.differing(mine, theirs, levels)
    assert leaves.count() == 1 and asked[0] == 1 and max(asked) <= 16 and len(asked) == levels + 1
    send, remove, touched = merkle.delta(local, remote, ["node_id"], levels=levels)
    assert [r.node_id for r in send.collect()] == ["n77"] and remove.count() == 0 and touched.count() == 1
    assert merkle.differing(mine, mine, levels)[0].count() == 0
    fewer = remote.where("node_id not in ('n1', 'n2')").unionByName(spark.createDataFrame([("x", None, 1), (None, "h", 1)], "node_id string, content_hash string, node int"))
    send, remove, _ = merkle.delta(local, fewer, ["node_id"])
    assert rows(send.select("node_id")) == rows(sync.delta(local, fewer, ["node_id"]).select("node_id")) and rows(remove) == [("x",)]
    assert merkle.delta(local, local.where("false"), ["node_id"])[0].count() == 5000 and merkle.delta(local.where("false"), local.where("false"), ["node_id"])[0].count() == 0


# --- history ----------------------------------------------------------------------------------------------------------


def test_a_point_lies_in_one_cell_of_a_cover(spark):
    rng = random.Random(3)
    spans = [(lo, lo + int(rng.expovariate(0.003))) for lo in (rng.randint(0, 5000) for _ in range(60))] + [(0, 0), (0, 70_000), (15, 16), (4096, 8191)]
    for (lo, hi), cells in zip(spans, spark.createDataFrame(spans, "lo long, hi long").select("lo", history.cells(F.col("lo"), F.col("hi")).alias("c")).collect()):
        covered = sorted(x for size, cell in cells.c for x in range(cell << size, (cell + 1) << size))
        assert covered == list(range(lo, hi + 1)) and len(cells.c) <= 150


def test_graph_at_each_commit_equals_replaying_them(spark):
    rng = random.Random(5)
    versions = [(f"k{rng.randint(0, 6)}", seq, rng.choice(["added", "modified", "modified", "deleted", None]), rng.choice("ab")) for seq in range(1, 60) for _ in range(rng.randint(0, 2))]
    df = spark.createDataFrame([*versions, (None, 3, "added", "a"), ("k1", None, "added", "a")], "key string, seq long, status string, value string")
    spans = history.intervals(df, ["key"], ["value"])
    got = {}
    for r in history.at_commits(spans, spark.createDataFrame([(s,) for s in range(0, 62)], "seq long")).collect():
        assert r.key not in got.setdefault(r.seq, {})
        got[r.seq][r.key] = r.value
    state = {}
    for seq in range(0, 62):
        here = {}
        for k, s, status, value in versions:
            if s == seq:
                here[k] = max(here.get(k, (False, "")), (status != "deleted", value))
        state |= here
        want = {k: v for k, (there, v) in state.items() if there}
        assert got.get(seq, {}) == want, seq
        if seq % 20 == 0:
            assert {r.key: r.value for r in history.as_of(spans, seq).collect()} == want
    commits = spark.sql("select * from values ('b', timestamp'2024-01-02 03:00:00'), ('a', timestamp'2024-01-02 03:00:00'), ('z', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-02 03:00:00') as t(hash, ts)")
    assert sorted((r.seq, r.hash) for r in history.numbered(commits).collect()) == [(1, "z"), (2, "a"), (3, "b")]


# --- ranges -----------------------------------------------------------------------------------------------------------


def test_a_file_of_many_nodes_and_ranges_is_swept(spark):
    rng = random.Random(8)
    nodes = [(k, "hot.go" if k % 3 else f"f{k % 5}.go", (s := rng.choice([0, None, rng.randint(1, 9000)])), (s or 0) + rng.choice([0, 3, 40, 3000]) if s else rng.choice([0, None, 7])) for k in range(700)]
    nodes += [(9000, None, 1, 2), (9001, "whole.go", 5, 6), (9002, "hot.go", 10, 0), (9002, "hot.go", 10, 0)]
    hunks = [("hot.go", (s := rng.randint(1, 9000)), s + rng.choice([0, 1, 5, 900])) for _ in range(40)] + [("f1.go", 5, 9), ("whole.go", None, None), ("f2.go", 1, 10_000), (None, 1, 5)]
    df = spark.createDataFrame([(*n, "x") for n in nodes], "id long, file_path string, start_line int, end_line int, row string")
    want = []
    for n in nodes:
        lo, hi = n[2] or 0, n[3] or 0
        hi = hi or lo
        if n[1] is not None and any(p == n[1] and ((lo == 0 and hi == 0) or a is None or (lo <= b and hi >= a)) for p, a, b in hunks):
            want.append(n[0])
    for width in (64, 1024):
        got = ranges.overlapping(df, spark.createDataFrame(hunks, "file_path string, start int, end int"), width)
        assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == df.columns


# --- similar entries --------------------------------------------------------------------------------------------------


def test_equal_entries_are_one_class_however_many(spark):
    same = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("entry"), F.lit("the key does not check").alias("content"))
    rest = spark.createDataFrame([("g", 30_000, "the key does not check twice"), ("g", 30_001, "wholly other words"), ("g", 30_002, ""), ("h", 1, "the key does not check"), ("g", 5, None)], "g string, entry long, content string")
    classes, members, links = memory.similar_classes(same.unionByName(rest), 0.7, ["g"])
    got = {(r.g, r.class_id): (r.n_members, r.n_links, r.least) for r in classes.collect()}
    assert got == {("g", 0): (20_000, 1, 0), ("g", 30_000): (1, 1, 0), ("g", 30_001): (1, 0, 30_001), ("h", 1): (1, 0, 1)}
    assert members.count() == 20_003 and [(r.a, r.b) for r in links.collect()] == [(0, 30_000)]


def test_pairs_follow_from_classes(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k % 2, k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 4)))) for k in range(50)], "g int, entry long, content string")
    _, members, links = memory.similar_classes(df, 0.4, ["g"])
    assert rows(memory.expanded(members, links, ["g"])) == rows(memory.similar_pairs(df, 0.4, ["g"]).select("g", "a", "b"))


def test_a_large_change_log_has_batches_of_several_files(spark, monkeypatch):
    from graphloom.plans import catalogue, stored

    seen, read = [], stored.changefeed.read_changes
    monkeypatch.setattr(stored, "LOG_ROWS", 500)
    monkeypatch.setattr(stored.changefeed, "read_changes", lambda *a, **b: seen.append(b["files_per_trigger"]) or read(*a, **b))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = catalogue.queries()["degrees_live"](spark, "/root/testdata/sf0.001")
    assert got.agg(F.sum("callee_count")).first()[0] == lines.where("l_returnflag <> 'R'").count() and seen == [round(lines.count() / 1500)]
