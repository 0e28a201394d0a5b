import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from graphloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, seq int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """Nodes by dictionaries of prefixes: (depth, smallest member) -> the other columns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        tokens = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += tokens
    return {
        (len(p), min(m)): (min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if rebuilt[c] == p))).encode()).hexdigest())
        for p, m in members.items()
    }


def found(df):
    rows = df.collect()
    out = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def alike(seed, convs=60, longest=9, words=2):
    """Conversations of few different turns: long common beginnings, copies, repeats, nulls, negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 140), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, t, 1, None]), rng.choice(["user", "user", "user", None]), rng.choice(["a", "a b", "", None][:words])))
    return rows + rows[:7] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (4, 3)])
def test_trie_against_dictionaries(spark, seed, chunk):
    rows = alike(seed, words=1 + seed % 4)
    assert found(pt.prefix_trie(made(spark, rows), chunk)) == brute(rows)


def test_copies_longer_than_a_block_and_chains(spark):
    """A third of all conversations are equal, one is very long, some are beginnings of it."""
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 400, 2) for t in range(5)]
    rows += [(1001, t, "user", f"long {t % 7} of it") for t in range(300)] + [(1041, t, "user", f"long {t % 7} of it") for t in range(150)] + [(20 * k, 9, "x", "y") for k in range(5)]
    rows += [(c, t, "user", f"copy {t}" if t < 4 else f"own {c}") for c in range(1, 200, 2) for t in range(6)]
    want = brute(rows)
    for chunk in (1024, 64):
        assert found(pt.prefix_trie(made(spark, rows).repartition(7), chunk)) == want


def blocks(seqs, cuts):
    """All nodes of sorted (seq, conv) by blocks that end at ``cuts``, without Spark; plan worked out by hand from all LCPs."""
    out, plan, bounds = [], {}, [0, *cuts, len(seqs)]
    lcp = [0] + [pt.common_symbols(a[0], b[0]) for a, b in zip(seqs, seqs[1:])] + [0]
    for part, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        starts = {}
        for depth in range(1, lcp[lo] + 1):
            at = lo
            while lcp[at] >= depth:
                at -= 1
            starts[depth] = max(k for k in range(len(bounds) - 1) if bounds[k] <= at)
        last = {s: d for d, s in starts.items()}
        plan[part] = (lcp[lo], lcp[hi], list(last), list(last.values()))
        block = pt.Block(part, *plan[part])
        for k in range(lo, hi):
            block.add(seqs[k][1], seqs[k][0], [1] * 20, -1 if k == lo else lcp[k], None)
        block.finish()
        out += block.taken()
    return out, plan


def test_minima_of_blocks_say_where_nodes_began(spark):
    rng = random.Random(4)
    for trial in range(3):
        seqs = sorted((b"".join(bytes([rng.randint(0, 1)]) * pt.WIDTH for _ in range(rng.randint(0, 7))), c) for c in range(40))
        seqs = [(b"\0" * pt.WIDTH + s, c) for s, c in seqs]
        cuts = sorted(rng.sample(range(1, 40), 9))
        rows = [(bytearray(s), c, sum(k >= x for x in cuts), k, -1 if k in (0, *cuts) else pt.common_symbols(seqs[k - 1][0], s)) for k, (s, c) in enumerate(seqs)]
        ordered = spark.createDataFrame(rows, "seq binary, conv_id long, part int, pos long, lcp int")
        want = blocks(seqs, cuts)[1]
        got = pt.block_plan(ordered)
        assert {k: (v[0], v[1], list(v[2]), list(v[3])) for k, v in got.items()} == want
        parts = spark.createDataFrame(pt._frames(blocks(seqs, cuts)[0]).astype(object).where(lambda x: x.notna(), None), pt.FIELDS)
        whole = {}
        for r in parts.where("kind = 'node'").unionByName(pt.crossing_nodes(parts)).collect():
            for depth in range(r.top + 1, r.depth + 1):
                whole[depth, r.least] = r.n
        count = defaultdict(list)
        for s, c in seqs:
            for d in range(1, len(s) // pt.WIDTH + 1):
                count[s[: d * pt.WIDTH]].append(c)
        assert whole == {(len(p) // pt.WIDTH, min(m)): len(m) for p, m in count.items()}


def test_empty_and_odd_tables(spark):
    assert pt.prefix_trie(made(spark, [])).count() == 0
    assert pt.prefix_trie(made(spark, [(None, None, None, None)])).count() == 0
    rows = [(0, None, None, None), (3, 5, "user", "only")]
    assert found(pt.prefix_trie(made(spark, rows))) == brute(rows)


def test_repeated_rows_are_turns(spark):
    rows = [(7, 1, "user", "again")] * 50 + [(7, 1, "a", "b"), (20, 0, "user", "again")] + [(20, 0, "user", "again")] * 3 + [(21, 2, "q", "w")] * 6
    got = pt.prefix_trie(made(spark, rows), 8)
    assert found(got) == brute(rows)
