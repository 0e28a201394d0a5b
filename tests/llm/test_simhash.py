import random
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.components import connected_components


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def sample_docs(n, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 40, 200])))))
    return docs


def test_fingerprints_match_brute_force():
    texts = ["", None, "One", "a B c", "a b\tc d\x0be", "É È x y É È x y", *(t for _, t in sample_docs(60))]
    assert [int(x) for x in simhash.fingerprints(texts, 3)[:, 0]] == [brute_fingerprint(t, 3) for t in texts]


def test_walk_finds_every_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12), dtype=np.uint64)
    keys = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    forest = simhash._Forest(len(keys))
    simhash.walk(keys, None, 64, 2, lambda i, j: np.ones(len(i), bool), forest, at_once=50)
    want = brute_components(range(len(keys)), lambda a, b: int(keys[a] ^ keys[b]).bit_count() <= 2)
    assert {i: int(x) for i, x in enumerate(forest.label)} == want


def test_leaf_pairs_cover_budget():
    starts, depths = np.array([0, 0b100 << 61, 0b101 << 61, 0b11 << 62], np.uint64), np.array([1, 3, 3, 2])
    pairs = lambda block, budget: {tuple(p) for p in simhash.leaf_pairs(starts, depths, block, budget).tolist()}
    assert pairs(0, 0) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert pairs(0, 3) == {(a, b) for a in range(4) for b in range(a, 4)}
    assert pairs(1, 3) == {(0, 0), *((a, b) for a in range(1, 4) for b in range(a, 4))}


def test_trie_links_do_not_depend_on_the_leaves(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64) | (np.uint64(5) << np.uint64(60))
    flips = np.uint64(1) << rng.integers(0, 64, (30, 20), dtype=np.uint64)
    keys = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), ((base[:, None] ^ flips) ^ flips[::-1]).ravel()]))
    frame = spark.createDataFrame(pd.DataFrame({"key": keys.view(np.int64)}))
    want = brute_components([int(k) for k in keys.view(np.int64)], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for leaf_rows in (1 << 15, 40, 3):
        got = {r.node: r.component for r in connected_components(simhash.trie_links(frame, 2, leaf_rows)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_tries_of_few_leaves_are_built_once(spark, monkeypatch):
    rng, tries, leaves_of = random.Random(3), [], simhash.trie_leaves
    keys = list({k ^ 1 << rng.randrange(63) for k in (rng.getrandbits(63) for _ in range(50)) for _ in range(4)})
    want = brute_components(keys, lambda a, b: (a ^ b).bit_count() <= 3)
    monkeypatch.setattr(simhash, "trie_leaves", lambda k, bits, rows, n: tries.append(n) or leaves_of(k, bits, rows, n))
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    for leaf_rows in (60, 3):
        got = {r.node: r.component for r in connected_components(simhash.trie_links(frame, 3, leaf_rows)).collect()}
        assert {k: got.get(k, k) for k in keys} == want
    assert tries == [1, 4]


def test_components_against_brute_force(spark):
    docs = sample_docs(150) + [(400, None), (401, " "), (402, "one\nword"), (402, "one word"), (None, "one word")]
    got = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string"), leaf_rows=8).collect()
    prints = sorted({brute_fingerprint(t, 3) for _, t in docs})
    group = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, t in docs:
        g = group[brute_fingerprint(t, 3)]
        least[g] = min(x for x in (least.get(g), d) if x is not None)
    key = lambda r: (r[0] is None, r)
    want = [(d, f"{brute_fingerprint(t, 3):016x}", least[group[brute_fingerprint(t, 3)]]) for d, t in docs]
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_components_of_nothing(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(500)]
    docs, truth = [], []
    for g in range(40):
        words = rng.choices(vocab, k=300)
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(c):  # each change breaks five of about 300 shingles
                copy[rng.randrange(300)] = "changed"
            docs.append((len(docs), " ".join(copy), f"x{g}"))
            truth.append(g)
    docs += [(1000, None, "a"), (1001, "", "b"), (1001, "", "b")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, node string"), leaf_rows=16)
    assert got.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in got.collect()) == sorted({min(i for i, g in enumerate(truth) if g == h) for h in truth} | {1000})


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}


def test_families_below_the_threshold_stay_whole(spark):
    rng = random.Random(7)
    line = " ".join(f"line{i}" for i in range(12))
    swamped = [" ".join([*[line] * 40, *(f"own{t}x{rng.randrange(10**6)}" for _ in range(200))]) for t in range(20)]
    core = [f"core{i}" for i in range(400)]
    close = []  # about 0.73 of any two texts' shingles are shared
    for t in range(120):
        close.append(" ".join([*core, *(f"tail{t}x{i}" for i in range(73))] if t % 2 else [*(f"head{t}x{i}" for i in range(73)), *core]))
    assert kept_ids(spark, swamped + close) == set(range(140))


def test_pipeline_fingerprints_are_of_sets(spark):
    rng = random.Random(9)
    words = [f"p{rng.randrange(10**6)}" for _ in range(1000)]
    texts = [" ".join(words), " ".join([*words[:500], *words[480:500] * 10, *words[500:]])]
    docs = spark.createDataFrame([(i, i, i, t) for i, t in enumerate(texts)], "doc_id long, node long, other long, text string").coalesce(1)
    lanes = [np.array(r.l, np.int64) for r in simhash.scan_texts(docs, 5, 4).where("piece is null").orderBy("doc_id").collect()]
    assert np.bitwise_count((lanes[0] ^ lanes[1]).view(np.uint64)).sum() < 20


def test_isolated_pairs_at_the_threshold_are_all_found(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(150):  # each of 6 changes breaks five of 300 shingles: 270 of 330 are shared
        words = [f"q{rng.randrange(10**9)}" for _ in range(304)]
        changed = list(words)
        for at in range(6):
            changed[20 + 45 * at] = f"other{rng.randrange(10**9)}"
        texts += [" ".join(words), " ".join(changed)]
    assert kept_ids(spark, texts) == set(range(0, 300, 2))


def exact_kept(texts, shingle=5, similarity=0.8):
    """Ids that stay if all pairs of shingle sets are compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    near = lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9
    return set(brute_components(range(len(texts)), near).values())


def test_families_of_all_sizes_against_all_pairs(spark):
    """Families of 2 to 60 texts at random similarities around the threshold: just what exact comparison keeps stays."""
    rng = random.Random(21)
    texts = []
    for size in (2, 3, 5, 9, 17, 60):
        core = [f"c{rng.randrange(10**9)}" for _ in range(240)]
        for _ in range(size):
            words = list(core)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words[rng.randint(0, 12) : len(words) - rng.randint(0, 12)]))
    texts += ["short text here", "short text here", "short  text HERE", "one two three four five six", "one two three four five seven", "", None, " "]
    assert kept_ids(spark, texts) == exact_kept(texts)


def test_small_leaves_hot_shingles_and_colliding_names_change_nothing(spark, monkeypatch):
    rng = random.Random(22)
    line = [f"line{i}" for i in range(30)]
    texts = []
    for k in range(300):  # a passage that nearly all texts share, with few words of their own
        texts.append(" ".join([*line, *(f"own{k % 200}x{i}" for i in range(rng.choice([2, 4, 6])))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_kept(texts)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want
    monkeypatch.setattr(simhash, "SPREAD_ROWS", 20)
    names = lambda text: (F.pmod(F.xxhash64(text), F.lit(7)), F.xxhash64(F.lit(7), text))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, leaf_rows=16, name=names).collect()} == want


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, __n long")
    assert simhash.drop_near_duplicates(docs).collect() == []
    rows = [(1, "a b c", 1), (1, "a b c", 2), (2, "a b c", 3), (None, "z", 4), (None, "z", 5), (3, None, 6)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, least long")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == [(False, 1, "a b c"), (False, 3, ""), (True, 0, "z")]


def test_query_columns_of_any_name_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, long, "a", 1, 2), (2, long + " tail", "b", 1, 2), (3, "short one", "c", 1, 2), (3, "short one", "c", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n int, component long")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = {d: f"{brute_fingerprint(t, 3):016x}" for d, t, *_ in rows}
    near = (int(prints[1], 16) ^ int(prints[2], 16)).bit_count() <= 2
    assert got == {(1, prints[1], 1), (2, prints[2], 1 if near else 2), (3, prints[3], 3)}


def test_leaves_do_not_depend_on_how_many_counts_a_round_brings(spark):
    rng = np.random.default_rng(6)
    rows = [(t, int(x)) for t in range(3) for x in rng.integers(-(1 << 62), 1 << 62, 300)] + [(0, int(x)) for x in rng.integers(0, 1 << 50, 300)]
    keys = spark.createDataFrame(rows, "t int, key long")
    want = simhash.trie_leaves(keys, 32, 20, 3)
    assert {k: sorted(v) for k, v in simhash.trie_leaves(keys, 32, 20, 3, counted=16).items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(len(v) for v in want.values()) > 40


def test_cell_counts_are_added_up_in_rounds(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").alias("node"), F.col("id").alias("other"), F.concat(F.lit("one two three four five "), F.col("id").cast("string")).alias("text")).repartition(9)
    scanned = simhash.materialise(simhash.scan_texts(docs, 5, 1))
    assert (simhash.shingle_levels(scanned, fan=2) == simhash.shingle_levels(scanned)).all()
    assert (simhash.shingle_levels(scanned.where("false")) == 0).all()


def test_a_leader_of_many_pairs_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPREAD_ROWS", 10)
    pairs = spark.range(1, 200).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(5, 6)], "a long, b long"))
    texts = spark.range(200).select(F.col("id").alias("node"), F.concat(F.lit("t"), "id").alias("text"))
    got = simhash.with_text(simhash.with_text(pairs, texts, "a", "b", "ta", 200), texts, "b", "a", "tb", 200)
    assert sorted((r.a, r.b) for r in got.where("ta = concat('t', a) and tb = concat('t', b)").collect()) == sorted((r.a, r.b) for r in pairs.collect())
