import hashlib
import random
import re

import duckdb
import numpy as np

from graphloom.llm import decontaminate as d
from graphloom.llm import sql


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        ids = words(body)
        for at in range(max(1, len(ids) - window + 1)) if ids else ():
            part = ids[at : at + window]
            for k in range(len(w) - len(part) + 1):
                if w[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def case(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["été", "ßa"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([2, 3, 9, 10, 14, 30])))) for k in range(12)] + [(99, ""), (98, None)]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choices([*vocab, "Zz", "q-q"], k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(items)[1] or "")
        docs.append((k, ", ".join(parts).title()))
    return items, [*docs, (100, None), (101, ""), (102, "...")]


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 4, 400)
    seq[-1] = 0
    index = d.FMIndex(seq)
    for _ in range(200):
        p = rng.integers(1, 4, rng.integers(1, 6))
        lo, hi = index.search(np.array([p]), np.array([len(p)]))
        want = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def test_scan_against_brute_force(spark):
    items, docs = case()
    got = d.scan_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: brute(t, items) for k, t in docs}


def test_empty_tables(spark):
    items, docs = case()
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.scan_documents(none, bench).count() == 0
    all_ = spark.createDataFrame(docs, "doc_id long, text string")
    assert d.scan_documents(all_, bench.where("false")).where("contaminated").count() == 0


def test_removal_leaves_no_window(spark):
    items, docs = case()
    frame = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, n_chars long")
    got = d.remove_spans(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    before = dict(docs)
    for r in got:
        assert not brute(r.text, items)[4]
        if not brute(before[r.doc_id], items)[4]:
            assert r.text == before[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_several_sets_of_windows_give_the_same(spark):
    items, docs = case(3)
    items += [(3, "w1 w2 w3"), (3, "w4 w5")]  # an id of two texts
    frame, bench = spark.createDataFrame(docs + docs[:3], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((k, *brute(t, items)) for k, t in docs + docs[:3])
    for chars in (10**6, 200):
        assert sorted(map(tuple, d.scan_documents(frame, bench, set_chars=chars).collect())) == want
    for r in d.remove_spans(frame, bench, set_chars=200).collect():
        assert not brute(r.text, items)[4]


def test_long_texts_and_clashing_columns(spark):
    items = [(1, "needle " * 12), (2, " ".join(f"w{k}" for k in range(25)))]
    long = " ".join(["hay"] * 200_000 + ["w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"] + ["needle"] * 15)
    rows = [(1, long, "x", 0), (1, long, "x", 0), (None, "NEEDLE " * 10, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, items string, spans int")
    got = sorted(map(tuple, d.scan_documents(frame, spark.createDataFrame(items, "item_id long, text string")).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(1, *brute_long(long, items))] * 2 + [(None, *brute("NEEDLE " * 10, items))]


def brute_long(text, items):
    """``brute`` by positions of the windows' first words."""
    w, hit, found = words(text), set(), set()
    for item, body in items:
        ids = words(body)
        for at in range(len(ids) - 9):
            part = ids[at : at + 10]
            for k in (i for i, x in enumerate(w) if x == part[0]):
                if w[k : k + 10] == part:
                    hit.update(range(k, k + 10))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = d.op9_benchmark_decontamination(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(sql.DECONTAMINATION).fetchall())


def test_long_items_are_split_and_sets_stay_small(spark):
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in rng.integers(0, 5000, 40_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "a few words only"), (3, " ".join(words[100:130]))], "item_id string, text string")
    pieces = d.item_pieces(items, 10, 20_000).collect()
    assert len(pieces) > 10 and max(len(r.text) for r in pieces) < 30_000
    whole, parts = d.Windows([("1", " ".join(words))]), d.Windows([(r.item_id, r.text) for r in pieces if r.item_id == "1"])
    named = lambda w: {tuple(x[x > 0].tolist()) for x in w.patterns}
    back = {v: k for k, v in parts.number.items()}
    assert {tuple(whole.number[back[x]] for x in p) for p in named(parts)} == named(whole)
    docs = spark.createDataFrame([(1, " ".join(words[95:140])), (2, "quite a few words only here"), (3, "none of it")], "doc_id long, text string")
    for chars in (10_000, 4_000_000):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in d.scan_documents(docs, items, set_chars=chars).collect()}
        assert got == {1: (45, 2), 2: (4, 1), 3: (0, 0)}


def test_windows_of_a_full_set_are_small():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{k}" for k in rng.integers(0, 30_000, 150_000))
    windows = d.Windows([("x", text)])
    assert sum(x.nbytes for x in (windows.patterns, windows.flat, windows.widths, windows.first, windows.lengths)) < 80 * len(windows.patterns)
