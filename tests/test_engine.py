import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import memory, tables

MAIN = """package svc

type Store interface {
\tLoad(id string) error
}

type DB struct{}

func (d *DB) Load(id string) error { return query(id) }

func query(id string) error { return nil }

func Handle(id string) error {
\treturn query(id)
}

func Setup(r *gin.Engine) { r.GET("/items/:id", authGuard, Handle) }
"""
TEST = "package svc\n\nfunc TestHandle(t *testing.T) {\n\tHandle(\"1\")\n}\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "svc").mkdir()
    (root / "svc" / "core.go").write_text(MAIN)
    (root / "svc" / "core_test.go").write_text(TEST)
    e = Engine(spark, str(tmp_path_factory.mktemp("graph")), embed_fn=lambda texts: [[float(len(t) % 7 + 1), float(t.count("a") + 1)] for t in texts], explain_fn=lambda p: p[:5])
    e.root = root
    e.stats = {r.label: (r.processed, r.resolved) for r in e.index(str(root), "o/r").collect()}
    return e


def test_index_and_questions(engine):
    assert engine.stats["tests"] == (1, 1) and engine.stats["route"] == (1, 1) and engine.stats["implements"] == (1, 1)
    assert engine.lookup("svc.Handle").first().node_id == "function:svc⋅Handle"
    assert {r.qualified for r in engine.blast("query").collect()} >= {"svc.DB.Load", "svc.Handle"}
    assert {r.node_id for r in engine.trace("Handle").collect()} == {"function:svc⋅query"}
    assert [r.qualified for r in engine.tests_for("Handle").collect()] == ["svc.TestHandle"] and [r.qualified for r in engine.subjects_for("TestHandle").collect()] == ["svc.Handle"]
    assert [r.qualified for r in engine.resolve_interface("Store").collect()] == ["svc.DB"]
    row = engine.api_surface().first()
    assert (row.method, row.path, row.handler, row.auth_chain) == ("GET", "/items/:id", "svc.Handle", ["authGuard"])
    assert engine.neighborhood("query").first().callers and engine.show_node("class:svc⋅DB").count() == 1
    diff = engine.spark.createDataFrame([("svc/core.go", None, "modified", "@@ -1 +11,1 @@")], "path string, old_path string, status string, patch string")
    assert {(r.qualified, r.role) for r in engine.diff_impact(diff).collect()} >= {("svc.query", "changed"), ("svc.Handle", "affected")}
    assert engine.query("handle items", top_k=3, min_score=0.1).count() == 3 and engine.explain("handle items", min_score=0.1) == "handl"
    assert engine.similar_to("Handle", 2).count() == 2 and engine.scan_security().columns == ["node_id", "category", "severity"]
    assert engine.list_files()[0].count() == 2 and engine.index_status().first().is_stale is False and engine.list_repos().first().slug == "o/r"
    assert {(r.kind, r.value): r.n for r in engine.plan_analysis().collect()}[("endpoint", "route")] == 1
    assert engine.field_flow("Handle").count() > 0
    with pytest.raises(LookupError):
        engine.store.put_nodes(engine.store.nodes.where("name = 'query'").withColumns({"qualified": F.lit("z.query"), "node_id": F.lit("function:z⋅query"), "file_path": F.lit("z.go")}))
        engine.trace("query")


def test_second_index_skips_and_drops(engine):
    before = engine.store.nodes.count()
    engine.index(str(engine.root), "o/r")
    assert engine.store.nodes.count() == before - 1  # the stray node's file is not on disk
    (engine.root / "svc" / "core_test.go").unlink()
    engine.index(str(engine.root), "o/r")
    assert engine.store.nodes.where("name = 'TestHandle'").count() == 0 and engine.store.edges.where("label = 'tests'").count() == 0
    assert engine.store.nodes.where("name = 'Handle'").count() == 1


def repo(tmp_path, **sources):
    for name, body in sources.items():
        (tmp_path / f"{name}.py").write_text(body)
    return str(tmp_path)


def calls(engine):
    return {(r.from_id, r.to_id, r.target, r.resolved) for r in engine.edges(labels=["calls"]).collect()}


def test_an_edited_file_keeps_the_edges_into_it(spark, tmp_path, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("graph")))
    root = repo(tmp_path, a="def target():\n    return 1\n", b="def caller():\n    return target()\n\ndef other():\n    return caller()\n")
    engine.index(root, "o/r")
    both = {("function:b⋅caller", "function:a⋅target", "target", True), ("function:b⋅other", "function:b⋅caller", "caller", True)}
    assert calls(engine) == both
    defines = engine.edges(labels=["defines"]).count()
    repo(tmp_path, a="def target():\n    return 2\n")
    engine.index(root, "o/r")
    assert calls(engine) == both and engine.edges(labels=["defines"]).count() == defines
    repo(tmp_path, a="def renamed():\n    return 2\n")  # the target goes: the caller still says it
    engine.index(root, "o/r")
    assert calls(engine) == {("function:b⋅caller", "target", "target", False), ("function:b⋅other", "function:b⋅caller", "caller", True)}
    repo(tmp_path, c="def target():\n    return 3\n")  # and finds another one
    engine.index(root, "o/r")
    assert calls(engine) == {("function:b⋅caller", "function:c⋅target", "target", True), ("function:b⋅other", "function:b⋅caller", "caller", True)}
    (tmp_path / "b.py").unlink()
    engine.index(root, "o/r")
    assert calls(engine) == set() and {r.qualified for r in engine.nodes().where("label = 'function'").collect()} == {"a.renamed", "c.target"}
    log = {(r.op, r.kind, r.id) for r in engine.store.log().collect()}
    assert {("put", "node", "function:a⋅target"), ("delete", "node", "function:a⋅target"), ("delete", "edge", "function:b⋅other")} <= log


def test_generated_values_follow_the_body(spark, tmp_path, tmp_path_factory):
    long = "def f():\n" + "".join(f"    x{k} = {k}\n" for k in range(60))
    asked, deltas, stages = [], [], []
    engine = Engine(spark, str(tmp_path_factory.mktemp("graph")), embed_fn=lambda texts: [[float(len(t)), 1.0] for t in texts], summarise_fn=lambda texts: [(f"{len(t)} long", ["endpoint"]) for t in texts],
                    on_delta=lambda d: deltas.append({(r.op, r.kind, r.name) for r in d.collect()}), on_stage=lambda *x: stages.append(x))
    root = repo(tmp_path, a=long, b="def g():\n    return f()\n")
    engine.index(root, "o/r")
    row = lambda name: engine.nodes().where(F.col("name") == name).first()
    first = row("f")
    assert first.summary == f"{len(first.body)} long" and first.concepts == ["endpoint"] and first.embedding and row("g").summary is None
    assert ("put", "node", "a.f") in deltas[0] and ("store", "completed") in stages and engine.tracker.counts["parse"] == 2
    repo(tmp_path, a=long + "    return 7\n")
    engine.index(root, "o/r", fast=True)
    assert row("f").summary is None and row("f").embedding is None and row("g").embedding == [float(x) for x in row("g").embedding]
    assert engine.tracker.state["embed"] == "skipped"
    assert engine.summarise("o/r") == 1 and row("f").summary == f"{len(row('f').body)} long"
    changed = engine.nodes().where("name = 'g'")
    assert engine.reembed("o/r", changed, engine.edges().where("label = 'calls'")) == 1 and row("f").embedding  # the other end of its edge
    assert engine.reembed("o/r", changed, engine.edges().where("label = 'calls'"), force=True) == 2
    repo(tmp_path, a="def broken(:\n")
    engine.index(root, "o/r")
    assert engine.tracker.errors["parse"] and engine.tracker.state["store"] == "completed"


def git(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, text=True).stdout.strip()


def test_git_identity_and_history_of_nodes(spark, tmp_path, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("graph")))
    git(tmp_path, "init", "-q")
    git(tmp_path, "remote", "add", "origin", "git@h.example:team/app.git")
    versions = [{"a": "def f():\n    return 1\n"}, {"a": "def f():\n    return 1\n\ndef g():\n    return f()\n"}, {"b": "x = 1\n"}, {"a": "def f():\n    return 2\n\ndef g():\n    return f()\n"}]
    hashes = []
    for k, files in enumerate(versions):
        repo(tmp_path, **files)
        git(tmp_path, "add", "-A")
        os.environ["GIT_COMMITTER_DATE"] = os.environ["GIT_AUTHOR_DATE"] = f"2024-01-0{k + 1}T00:00:00Z"
        git(tmp_path, "commit", "-qm", f"c{k}")
        hashes.append(git(tmp_path, "rev-parse", "HEAD"))
    engine.index(str(tmp_path))
    stored = engine.list_repos().first()
    assert (stored.slug, stored.remote_url, stored.last_commit) == ("team/app", "https://h.example/team/app", hashes[-1])
    assert engine.repo_of(str(tmp_path), "other/name")["slug"] == "team/app"  # known by its remote
    changes = {(r.key, r.hash, r.change) for r in engine.index_history(str(tmp_path), "team/app").collect()}
    assert changes == {("function:a⋅f", hashes[0], "added"), ("function:a⋅g", hashes[1], "added"), ("function:a⋅f", hashes[3], "modified")}
    nodes = {r.name: (r.introduced_commit, r.last_modified_commit) for r in engine.nodes().where("label = 'function'").collect()}
    assert nodes == {"f": (hashes[0], hashes[3]), "g": (hashes[1], hashes[1])}
    assert [r.introduced_commit for r in engine.edges(labels=["calls"]).collect()] == [hashes[1]]
    assert engine.repo_of(str(tmp_path_factory.mktemp("plain")))["remote_url"] is None


def test_push_and_pull(spark, tmp_path, tmp_path_factory):
    here, there = (Engine(spark, str(tmp_path_factory.mktemp(x))) for x in ("here", "there"))
    here.index(repo(tmp_path, a="def f():\n    return 1\n", b="def g():\n    return f()\n"), "o/r")
    bundle = str(tmp_path_factory.mktemp("bundle") / "one")
    manifest = here.push("o/r", bundle, ["o/*"], "key")
    assert manifest["node_count"] == here.nodes().count() and here.push("o/r", bundle + "2", ["o/*"], "key", manifest) is None
    with pytest.raises(PermissionError):
        there.pull("o/r", bundle, ["p/*"], "key")
    with pytest.raises(ValueError):
        there.pull("o/r", bundle, ["o/r"], "wrong")
    assert there.pull("o/r", bundle, ["o/r"], "key") == {"inserted": manifest["node_count"]}
    assert calls(there) == calls(here) and there.pull("o/r", bundle, ["o/r"], "key") is None


def test_writers_that_start_from_one_version_do_not_undo_each_other(spark, tmp_path):
    table = tables.SegmentTable(spark, str(tmp_path / "t"), "repo_slug string, label string, v int")
    rows = lambda *r: spark.createDataFrame(list(r), "repo_slug string, label string, v int")
    table.append(rows(("r/a", "x", 1), ("r/a", "y", 2), ("s", "x", 3), (None, "x", 4)))
    table.append(rows(("r/a", "x", 1)))
    assert sorted(r.v for r in table.read("r/a").collect()) == [1, 1, 2] and table.read("r/a", ["y"]).count() == 1
    seen = table.version()[0]
    table.replace(rows(("r/a", "x", 9)), [("r/a", "x")], seen)
    with pytest.raises(tables.ConcurrentWrite):
        table.replace(rows(("r/a", "x", 8)), [("r/a", "x")], seen)
    with pytest.raises(tables.ConcurrentWrite):
        table._commit(seen, [])
    assert sorted(r.v for r in table.read().collect()) == [2, 3, 4, 9]
    for k in range(6):
        table.replace(rows(("s", "x", k)), [("s", "x")])
    assert len(table._manifests()) == tables.KEPT and sorted(r.v for r in table.read().collect()) == [2, 4, 5, 9]


def test_sessions_messages_and_memories(spark, tmp_path):
    m = memory.MemoryStore(spark, str(tmp_path / "m"))
    at = lambda k: dt.datetime(2024, 1, k)
    m.put_sessions(spark.createDataFrame([("s1", "r", "one", at(1)), ("s2", "r", "two", at(2))], "session_id string, repo_slug string, title string, created_at timestamp"))
    m.put_sessions(spark.createDataFrame([("s1", "r", "first", at(1))], "session_id string, repo_slug string, title string, created_at timestamp"))
    assert [(r.session_id, r.title) for r in m.sessions("r").collect()] == [("s2", "two"), ("s1", "first")]
    message = "session_id string, message_id string, role string, content string, created_at timestamp"
    m.add_messages(spark.createDataFrame([("s1", "b", "assistant", "yes", at(2)), ("s1", "a", "user", "hello", at(1)), ("s1", "c", "user", " ", at(3))], message))
    with pytest.raises(Exception, match="role is robot"):
        m.add_messages(spark.createDataFrame([("s1", "d", "robot", "x", at(4))], message))
    assert [r.content for r in m.messages("s1").collect()] == ["hello", "yes"]
    ddl = "memory_id string, tier string, session_id string, repo_slug string, content string, embedding array<float>, created_at timestamp"
    rows = [(f"p{k}", "persistent", None, "r", f"fact {k}", [1.0, float(k)], at(1)) for k in range(7)] + [("n", "persistent", None, "r", "no vector", None, at(1))]
    rows += [(f"w{k}", "session", "s1", "r", "x" * 40, None, at(k + 1)) for k in range(4)]
    m.remember(spark.createDataFrame(rows, ddl))
    assert [r.memory_id for r in m.recall([1.0, 0.0], 3).collect()] == ["p0", "p1", "p2"]
    assert [r.memory_id for r in m.prefix("s1", [0.0, 1.0], 25).collect()] == ["w0", "w1", "w2", "p6", "p5", "p4", "p3", "p2"]
    m.delete_session("s1")
    assert m.messages("s1").count() == 0 and m.memories("s1").count() == 0 and m.sessions().count() == 1 and m.recall([1.0, 0.0], 9).count() == 7


def edges_of(engine):
    return sorted((r.label, r.from_id, r.to_id, r.resolved) for r in engine.store.edges.select("label", "from_id", "to_id", "resolved").collect())


def test_an_incremental_index_gives_the_edges_of_a_full_one(spark, tmp_path, tmp_path_factory):
    """A new file brings another candidate for a name that was resolved: edges out of files that did not change follow."""
    (tmp_path / "a.py").write_text("def caller():\n    return helper()\n")
    (tmp_path / "zz.py").write_text("def helper():\n    return 1\n")
    engine = Engine(spark, str(tmp_path_factory.mktemp("g")))
    engine.index(str(tmp_path), "o/r", fast=True).collect()
    (tmp_path / "b.py").write_text("def helper():\n    return 2\n")
    engine.index(str(tmp_path), "o/r", fast=True).collect()
    full = Engine(spark, str(tmp_path_factory.mktemp("g")))
    full.index(str(tmp_path), "o/r", fast=True).collect()
    assert edges_of(engine) == edges_of(full)
    assert ("calls", "function:a⋅caller", "function:b⋅helper", True) in edges_of(engine)


def test_a_writer_that_died_locks_nothing(spark, tmp_path):
    table = tables.SegmentTable(spark, str(tmp_path / "t"), "repo_slug string, label string, x int", ("repo_slug", "label"))
    row = spark.createDataFrame([("o/r", "a", 1)], "repo_slug string, label string, x int")
    table.append(row)
    base = table.version()[0]
    (tmp_path / "t" / f"version-{base + 1:08d}").write_text("")  # made by a writer that died before it wrote
    (tmp_path / "t" / ".writing-left").write_text("[")
    table.append(row)
    table.append(row)
    assert table.read().count() == 3 and table.version()[0] == base + 2
    for _ in range(2):  # a batch that is run again replaces itself
        table.append(row, "stream-4")
    assert table.read().count() == 4


def test_organised_copies_answer_like_the_store(spark, tmp_path, tmp_path_factory):
    (tmp_path / "a.py").write_text("def caller():\n    return helper()\n\n\ndef helper():\n    return 1\n")
    engine = Engine(spark, str(tmp_path_factory.mktemp("g")))
    engine.index(str(tmp_path), "o/r", fast=True).collect()
    ask = lambda: (engine.show_node("function:a⋅helper").select("node_id", "name").collect(), engine.lookup("helper").select("node_id").collect(), engine.lookup("a.caller").select("node_id").collect(), engine.blast("helper").collect())
    plain = ask()
    engine.organise()
    assert engine._at_hand() and ask() == plain and plain[0] and plain[1] and plain[3]
    assert "organised-" in engine.show_node("function:a⋅helper").inputFiles()[0]
    (tmp_path / "b.py").write_text("from a import helper\n\n\ndef other():\n    return helper()\n")
    engine.index(str(tmp_path), "o/r", fast=True).collect()
    assert engine._at_hand() is None and {r.qualified for r in engine.blast("helper").collect()} == {"a.caller", "b.other"}
    engine.organise()
    assert engine._at_hand() and {r.qualified for r in engine.blast("helper").collect()} == {"a.caller", "b.other"}
