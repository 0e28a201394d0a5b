import math

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.storage import cut
from graphloom.operators import memory, search, sync


def arm(spark, ids):
    return spark.createDataFrame([(n, k + 1) for k, n in enumerate(ids)], "node_id string, rank int")


def cent(spark, **c):
    return spark.createDataFrame(list(c.items()) or [("-", 0)], "node_id string, centrality int")


def test_rank_fusion(spark):
    ids = lambda *a, **k: [r.node_id for r in search.fuse(*a, **k).collect()]
    assert ids([arm(spark, []), arm(spark, [])]) == []
    assert ids([arm(spark, ["n1", "n2"]), arm(spark, [])]) == ["n1", "n2"] and ids([arm(spark, []), arm(spark, ["n1", "n2"])]) == ["n1", "n2"]
    three = search.fuse([arm(spark, ["n1", "n2"]), arm(spark, ["n1", "n3"])], centrality=cent(spark, n1=10, n2=5, n3=0)).collect()
    assert len(three) == 3 and [r.score for r in three] == sorted((r.score for r in three), reverse=True)
    assert ids([arm(spark, ["n1", "n2"])], centrality=cent(spark, n1=0, n2=100), k=60) == ["n2", "n1"]
    one = search.fuse([arm(spark, ["n1"])], k=-1).first().score
    assert one == round(1 / 61, 6)


def test_bm25_against_a_plain_implementation(spark):
    docs = [("a", "the cat sat"), ("b", "the dog Sat on the cat cat"), ("c", ""), ("d", "bird")]
    terms = ["cat", "sat", "nothing"]
    got = {r.id: r.score for r in search.bm25_scores(spark.createDataFrame(docs, "id string, t string"), "id", {"t": text.word_tokens(F.col("t"))}, terms).collect()}
    toks = {k: t.lower().split() for k, t in docs if t}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for k, w in toks.items():
        s = 0.0
        for term in terms:
            df, tf = sum(term in x for x in toks.values()), w.count(term)
            if tf:
                s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s:
            want[k] = round(s, 6)
    assert got == want


def test_expand_and_rerank(spark):
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "node_id string, score double")
    edges = spark.createDataFrame([("calls", "x", "a"), ("calls", "a", "b"), ("calls", "b", "x"), ("calls", "b", "y")], "label string, from_id string, to_id string")
    assert {(r.node_id, r.score, r.expanded) for r in search.expand(hits, edges).collect()} == {("a", 1.0, False), ("b", 0.5, False), ("x", 0.6, True), ("y", 0.3, True)}
    rows = spark.createDataFrame([("a", 1.0, ["user-auth"], 0), ("b", 1.0, None, 5), ("c", 1.0, ["x"], 10_000)], "node_id string, score double, concepts array<string>, centrality int")
    got = {r.node_id: r.score for r in search.concept_rerank(rows, "an AUTH of").collect()}
    assert got == {"a": 2.0, "b": round(1 + 0.1 * math.log(6), 6), "c": 1.3}


def test_hybrid_stages(spark):
    nodes = spark.createDataFrame([(f"n{k}", "function", f"getUser{k}", f"p.getUser{k}", "reads a user", f"src/{k}.go", ["user"], [1.0, float(k)]) for k in range(6)],
                                  "node_id string, label string, name string, qualified string, docstring string, file_path string, concepts array<string>, embedding array<float>")
    edges = spark.createDataFrame([("calls", "n5", "n0")], "label string, from_id string, to_id string")
    stages = dict(search.hybrid_stages(nodes, edges, cent(spark, n0=3), "getUser3", [1.0, 0.0], top_k=2, file_prefix="src/"))
    assert list(stages) == ["vector_hit", "fts_hit", "fused", "expanded", "reranked", "done"]
    assert stages["done"].count() == 2 and stages["vector_hit"].first().node_id == "n0" and stages["fts_hit"].first().node_id == "n3"
    assert search.vector_search(nodes, [1.0, 0.0], 3, min_score=1.0).collect()[0].score == 1.0
    assert [r.node_id for r in search.similar_to(nodes, "n0", [1.0, 0.0], 2).collect()] == ["n1", "n2"]


def test_embedding_of_distinct_texts(spark):
    nodes = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("c", "yy", None), ("d", "z", [1.0])], "node_id string, body string, embedding array<float>")
    got = {r.node_id: list(r.embedding) for r in search.embed_missing(nodes, F.col("body"), lambda ts: [[float(len(t))] for t in ts], batch=1).collect()}
    assert got == {"a": [1.0], "b": [1.0], "c": [2.0]}


def test_context_text(spark):
    row = spark.createDataFrame([("function", "p.F", "does " * 200, "b" * 9000)], "label string, q string, s string, body string")
    none = F.lit(None).cast("string")
    out = row.select(search.context_text(search.embed_budget(0), F.col("label"), F.col("q"), F.col("s"), none, F.array(F.lit("a"), F.lit("b")), none, F.col("body")).alias("x")).first().x
    assert out.startswith("[FUNCTION] p.F — does") and " Concepts: a, b.\n---\nbbb" in out and len(out) <= 6000


def test_budget_and_scores(spark):
    m = spark.createDataFrame([("s", "session", k, f"m{k}", 40) for k in range(5)], "session_id string, tier string, created_at int, memory_id string, token_count int")
    assert [r.memory_id for r in memory.session_context(m, 100).orderBy("created_at").collect()] == ["m0", "m1", "m2"]
    ddl = "g int, entry int, content string, source string, relevance double, confidence double, novelty double, actionability double"
    rows = [(0, 1, "the parser handles input well", "search", 0.9, 1.0, 2.0, 0.5), (0, 2, "the parser handles input well", "deep_dive", 0.9, 1.0, 0.8, 0.5), (0, 3, "unrelated words only", "x", 0.9, 0.9, 0.9, -1.0)]
    got = {r.entry: r for r in memory.validate(spark.createDataFrame(rows, ddl), "fix the parser", ["g"]).collect()}
    assert (got[1].confidence, got[1].novelty, got[1].relevance) == (0.7, 1.0, 0.9) and (got[2].confidence, got[2].novelty) == (0.95, 0.1)
    assert (got[3].relevance, got[3].confidence, got[3].actionability) == (0.5, 0.8, 0.0)
    assert got[1].priority == round(0.3 * 0.9 + 0.3 * 0.7 + 0.2 + 0.1, 6)


def test_contradictions_and_convergence(spark):
    rows = [(0, 1, "token check is present in handler", 0.9), (0, 2, "token check is not present in handler", 0.9), (0, 3, "token check is never present in handler", 0.2)]
    pairs = memory.contradictions(spark.createDataFrame(rows, "g int, entry int, content string, relevance double"), ["g"])
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    state = spark.createDataFrame([("ok", 3, 5, 0, 0, 1, 1, 1, 0), ("no", 1, 0, 1, 3, 0, 1, 0, 2)], "session string, delegations int, high_priority int, open_high int, last_novel int, previous_novel int, hypotheses int, concluded int, unresolved int")
    got = {r.session: (r.converged, r.failures.count(",")) for r in memory.convergence(state).collect()}
    assert got == {"ok": (True, 0), "no": (False, 5)}
    tried = memory.already_tried(spark.createDataFrame([("search", "find the auth handler"), ("trace", "find the auth handler")], "tool string, args string"), "search", "find the auth handler")
    assert tried.count() == 1


def test_similar_pairs_lose_nothing(spark):
    import random

    rng = random.Random(1)
    rows = [(k % 2, k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps1", "zeta", "eta1"], k=rng.randint(1, 6)))) for k in range(60)]
    words = {k: {w for w in t.split()} for _, k, t in rows}
    want = {(a, b) for a in words for b in words if a < b and a % 2 == b % 2 and len(words[a] & words[b]) / len(words[a] | words[b]) > 0.5}
    got = memory.similar_pairs(spark.createDataFrame(rows, "g int, entry int, content string"), 0.5, ["g"])
    assert {(r.a, r.b) for r in got.collect()} == want


def test_bundle(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "function", "body"), ("b", "class", None)], "node_id string, label string, body string")
    edges = spark.createDataFrame([("calls", "a", "b")], "label string, from_id string, to_id string")
    row = sync.export_bundle(nodes, edges, "o/r", str(tmp_path / "x"), "key")
    n, e, m = sync.read_bundle(spark, str(tmp_path / "x"), "key")
    assert "body" not in n.columns and e.count() == 1 and m["hash"] == row["hash"]
    assert sync.manifest(nodes.drop("body").orderBy("label"), edges, "o/r").first().hash == row["hash"]
    assert sync.manifest(nodes.drop("body").union(nodes.drop("body")), edges, "o/r").first().hash != row["hash"]
    try:
        sync.read_bundle(spark, str(tmp_path / "x"), "other")
        raise AssertionError
    except ValueError:
        pass
    assert sync.in_scope("o/r", ["o/*"]) and not sync.in_scope("p/r", ["o/*"]) and sync.needs_pull(None, m) and not sync.needs_pull(m, m)


def test_import_newest_wins(spark):
    ddl = "node_id string, content_hash string, last_modified_at int, body string"
    local = spark.createDataFrame([("same", "h", 1, "x"), ("old", "h", 1, "x"), ("new", "h", 9, "x"), ("mine", "h", 1, "x")], ddl)
    other = spark.createDataFrame([("same", "h", 5), ("old", "i", 5), ("new", "i", 5), ("theirs", "i", 5)], "node_id string, content_hash string, last_modified_at int")
    got = {r.node_id: (r.content_hash, r.body, r.action) for r in sync.merge_import(local, other, ["node_id"]).collect()}
    assert got == {"same": ("h", "x", "unchanged"), "old": ("i", "x", "updated"), "new": ("h", "x", "older"), "mine": ("h", "x", "local"), "theirs": ("i", None, "inserted")}
    assert {r.node_id for r in sync.delta(local, other, ["node_id"]).collect()} == {"old", "new", "mine"}


def test_approximate_search_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = cut(search.bucket_index(rows, rows.select(F.size("embedding")).first()[0], id_column="vec_id"))
    met, of = 0, 0
    for q in (0, 7, 42):
        v = list(rows.where(F.col("vec_id") == q).first().embedding)
        want = {r.vec_id for r in search.vector_search(rows, v, 5, id_column="vec_id").collect()}
        got = {r.vec_id for r in search.approximate_search(index, v, 5, id_column="vec_id").collect()}
        met, of = met + len(want & got), of + len(want)
    assert met >= 0.8 * of
