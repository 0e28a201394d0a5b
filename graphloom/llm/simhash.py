"""SimHash near-duplicate detection with a binary trie self-join.

Fingerprints: a text's words are lower-cased (A-Z), ``k`` consecutive words make a shingle (repeats count,
a shorter text is one shingle), XXH64 (seed 42) hashes it, and a bit is set if it is set in over half the
hashes.  Lane 0 is that 64-bit fingerprint; further lanes mix the same hashes again and lengthen it.

Self-join: fingerprints form a binary trie.  Pairs of trie nodes are walked down together, the bits in which
they differ add up, and a pair is dropped once they exceed the budget.  The top of the trie (its leaves hold a
bounded share of the fingerprints) is known to the driver; each pair of leaves within the budget is one group that a
task walks to the bottom.  With more than a few leaves the trie is built budget + 1 times, each time with another block
of the bits on top: two fingerprints within the budget agree in one whole block, so only leaves that agree in the
top block are paired and a fingerprint goes to few groups however many leaves there are.  Inside a task, ranges that
are already one component need no further walk, so groups of thousands of near copies cost about their size; a task
returns a spanning forest, never all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import join_spread, materialise, release, slices, table, unused
from graphloom.llm.components import connected_components

ONE = np.uint64(1)
SHINGLES_AT_ONCE = 1 << 17


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """SplitMix64 of the shingle hashes, another sequence for each lane."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, len(words) - k + 1)


#: the bits of a byte as eight bytes, in one number
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _ones(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set in the hashes from each of ``starts`` up to the next.

    Eight counters of a byte are added at once, over runs of 255 hashes, which no counter overflows.
    """
    sizes = np.diff(np.r_[starts, len(h)])
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    wide = SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(wide, at, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(counts, first, axis=0, dtype=np.int32)


def fingerprints(texts: list[str | None], k: int, lanes: int = 1) -> np.ndarray:
    """One row of ``lanes`` unsigned 64-bit words for each text; zeros for a text without words."""
    return fingerprints_of((shingle_hashes(text, k) for text in texts), len(texts), lanes)


def fingerprints_of(hashes: Iterable[np.ndarray], rows: int, lanes: int) -> np.ndarray:
    """``fingerprints`` of ``rows`` texts by the hashes of their shingles."""
    out = np.zeros((rows, lanes), np.uint64)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        sizes = np.array([len(h) for _, h in held])
        every, starts = np.concatenate([h for _, h in held]), np.r_[0, np.cumsum(sizes)[:-1]]
        for lane in range(lanes):
            ones = np.zeros((len(held), 64), np.int64)
            mixed = _mix(every, lane) if lane else every
            if len(held) == 1:  # a long text: its shingles in pieces
                for at in range(0, len(mixed), SHINGLES_AT_ONCE):
                    ones += _ones(mixed[at : at + SHINGLES_AT_ONCE], np.array([0]))
            else:
                ones = _ones(mixed, starts)
            out[[i for i, _ in held], lane] = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel()
        held.clear()

    n = 0
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        if n + len(h) > SHINGLES_AT_ONCE:
            flush()
            n = 0
        held.append((i, h))
        n += len(h)
    flush()
    return out


# --- the walk inside a task -------------------------------------------------------------------------------


class _Forest:
    """Vectorised union-find over row numbers; a label is the smallest row of its component.

    ``used`` has the pairs that joined two components, a spanning forest of the pairs added.
    """

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.used: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.label, high, low)
            won = np.flatnonzero(self.label[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.used.append(np.stack([i[won], j[won]], 1))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def whole(self) -> np.ndarray:
        """Prefix counts of label changes: a range whose two ends count alike is one component."""
        return np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])] if len(self.label) else np.zeros(0, np.int64)


def _product(alo, ahi, blo, bhi, same, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of node pairs, in pieces of about ``at_once``."""
    n = (ahi - alo) * (bhi - blo)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(np.cumsum(n[first:]), at_once)) + first)
        if last == first + 1 and n[first] > at_once:  # one large pair of nodes, by rows of its left side
            step = max(1, at_once // int(bhi[first] - blo[first]))
            for lo in range(int(alo[first]), int(ahi[first]), step):
                hi = min(lo + step, int(ahi[first]))
                i, j = np.repeat(np.arange(lo, hi), bhi[first] - blo[first]), np.tile(np.arange(blo[first], bhi[first]), hi - lo)
                yield (i[i < j], j[i < j]) if same[first] else (i, j)
        else:
            part = slice(first, last)
            own = np.repeat(np.arange(first, last), n[part])
            k = np.arange(len(own)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            width = (bhi - blo)[own]
            i, j = alo[own] + k // width, blo[own] + k % width
            keep = ~same[own] | (i < j)
            yield i[keep], j[keep]
        first = last


def _alongside(alo, ahi, blo, bhi, same, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of long node pairs: each row of the left side with ``run`` rows about as far into the right side."""
    for a, b, c, d, one in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), same.tolist()):
        for lo in range(a, b, 1 << 14):
            i = np.arange(lo, min(b, lo + (1 << 14)))
            there = i if one else c + (i - a) * (d - c) // (b - a) - run // 2
            for step in range(1, run + 1):
                j = there + step
                inside = (j >= c) & (j < d)
                yield i[inside], j[inside]


def walk(keys: np.ndarray, cut: int | None, bits: int, budget: int, accept, forest: _Forest, at_once: int = 1 << 16, run: int = 0) -> None:
    """Join the trie of sorted ``keys`` (top ``bits`` bits of uint64) with itself, or its parts before and from ``cut``.

    ``accept(i, j)`` says which row pairs, within the budget on the keys, are links; links go to ``forest``.  With ``run``
    the row pairs of long runs of equal keys are only those about as far into one run as into the other.
    """
    n = len(keys)

    ones: dict[int, np.ndarray] = {}

    def middle(lo, hi, depth):
        """Where the keys of a node turn from bit 0 to bit 1 at ``depth``."""
        if n <= 1 << 19:  # counts of ones up to each key, for each depth: faster, and of bounded size
            if depth not in ones:
                ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & ONE)].astype(np.int32)
            return hi - (ones[depth][hi] - ones[depth][lo])
        prefix = (keys[lo] >> np.uint64(64 - depth)) << ONE if depth else np.zeros(len(lo), np.uint64)
        return np.clip(np.searchsorted(keys, (prefix | ONE) << np.uint64(63 - depth)), lo, hi)

    for step in (1, 2, 3):  # neighbours in key order: most near copies join here, and their ranges need no walk
        i = np.arange(n - step)
        j = i + step
        i, j = i[np.bitwise_count(keys[i] ^ keys[j]) <= budget], j[np.bitwise_count(keys[i] ^ keys[j]) <= budget]
        ok = accept(i, j)
        forest.add(i[ok], j[ok])
    a = np.array([[0, n, 0, n, 0]] if cut is None else [[0, cut, cut, n, 0]])
    stack = [(0, a)]
    while stack:
        depth, a = stack.pop()
        alo, ahi, blo, bhi, diff = a.T
        marks = forest.whole()
        one = (marks[ahi - 1] == marks[alo]) & (marks[bhi - 1] == marks[blo]) & (forest.label[alo] == forest.label[blo])
        a = a[~one]
        if not len(a):
            continue
        alo, ahi, blo, bhi, diff = a.T
        same = alo == blo
        small = ((ahi - alo) * (bhi - blo) <= 16) | (depth == bits)
        if run and depth == bits:
            long_ = (ahi - alo) * (bhi - blo) > run * run
            for i, j in _alongside(alo[long_], ahi[long_], blo[long_], bhi[long_], same[long_], run):
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                near &= forest.label[i] != forest.label[j]
                i, j = i[near], j[near]
                ok = accept(i, j)
                forest.add(i[ok], j[ok])
            small &= ~long_
            alo, ahi, blo, bhi, diff, same, small = (z[~long_] for z in (alo, ahi, blo, bhi, diff, same, small))
        for i, j in _product(alo[small], ahi[small], blo[small], bhi[small], same[small], at_once):
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (forest.label[i] != forest.label[j])
            i, j = i[near], j[near]
            ok = accept(i, j)
            forest.add(i[ok], j[ok])
        alo, ahi, blo, bhi, diff, same = alo[~small], ahi[~small], blo[~small], bhi[~small], diff[~small], same[~small]
        if not len(alo):
            continue
        am, bm = middle(alo, ahi, depth), middle(blo, bhi, depth)
        other = ~same
        down = np.concatenate([
            np.stack([alo, am, blo, bm, diff], 1), np.stack([am, ahi, bm, bhi, diff], 1), np.stack([alo, am, bm, bhi, diff + 1], 1),
            np.stack([am[other], ahi[other], blo[other], bm[other], diff[other] + 1], 1),
        ])
        down = down[(down[:, 1] > down[:, 0]) & (down[:, 3] > down[:, 2]) & (down[:, 4] <= budget)]
        alone = (down[:, 0] == down[:, 2]) & (down[:, 1] - down[:, 0] == 1)
        down = down[~alone]
        stack += [(depth + 1, down[at : at + at_once]) for at in range(0, len(down), at_once)]


# --- the walk over the top of the trie --------------------------------------------------------------------

#: leaves that a trie has at least before they grow with the fingerprints
LEAVES = 1 << 14


class Tops:
    """Leaves of several tries (numbered) and the pairs of leaves that are walked, all of bounded number."""

    def __init__(self, leaves: dict[int, list[tuple[int, int]]], tries: int, block: int, budget: int) -> None:
        self.starts, self.base, pairs, base = [], [], [], 0
        for t in range(tries):
            mine = sorted(leaves.get(t, []), key=lambda x: x[0] << (64 - x[1]))
            self.starts.append(np.array([p << (64 - d) for p, d in mine], np.uint64))
            self.base.append(base)
            found = leaf_pairs(self.starts[-1], np.array([d for _, d in mine], np.int64), block, budget)
            pairs.append(found + base)
            base += len(mine)
        self.pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        self.begin = np.concatenate(self.starts) if self.starts else np.zeros(0, np.uint64)
        two = self.pairs[:, 0] != self.pairs[:, 1]
        leaf, pair = np.r_[self.pairs[:, 0], self.pairs[two, 1]], np.r_[np.arange(len(self.pairs)), np.flatnonzero(two)]
        self.flat = pair[np.argsort(leaf, kind="stable")]
        self.width = np.bincount(leaf, minlength=base).astype(np.int64)
        self.first = np.cumsum(self.width) - self.width

    def of(self, trie: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Leaves of keys."""
        out = np.zeros(len(key), np.int64)
        for t in np.unique(trie):
            mine = trie == t
            out[mine] = self.base[t] + np.searchsorted(self.starts[t], key[mine], side="right") - 1
        return out


#: counts that a round of ``trie_leaves`` brings to the driver, about
COUNTED = 1 << 17


def trie_leaves(keys: DataFrame, bits: int, leaf_rows: int, tries: int = 1, counted: int = COUNTED) -> dict[int, list[tuple[int, int]]]:
    """Leaves (prefix, depth) of the top of each trie: each holds at most ``leaf_rows`` keys or is ``bits`` deep.

    ``keys`` has the trie's number in ``t``, below ``tries``, and a long ``key`` whose top ``bits`` bits count.  Each round
    counts the descendants of the prefixes that are still too full, as many bits further down as give about ``counted``
    counts, one bit at least: they come to the driver, and too full prefixes are at most all keys / ``leaf_rows`` a trie.
    """
    spark = keys.sparkSession
    leaves: dict[int, list[tuple[int, int]]] = {}
    open_, depth = None, 0
    while open_ is None or open_:
        step = max(1, (counted // max(1, tries if open_ is None else len(open_))).bit_length() - 1)
        deeper = min(bits, depth + min(step, 12))
        at = keys.select("t", F.shiftrightunsigned("key", 64 - deeper).alias("p"))
        if depth:
            full = spark.createDataFrame(open_, "t int, q long")  # as many prefixes as there are keys / leaf_rows, at most
            at = at.join(F.broadcast(full), (at["t"] == full["t"]) & (F.shiftright("p", deeper - depth) == F.col("q")), "left_semi")
        sums: dict[tuple[int, int, int], int] = {}
        for r in at.groupBy("t", "p").count().toLocalIterator():
            for d in range(depth, deeper + 1):
                name = (r["t"], r["p"] >> (deeper - d), d)
                sums[name] = sums.get(name, 0) + r["count"]
        level = [(t, q, depth) for t, q in open_] if depth else sorted({(t, 0, 0) for t, _, _ in sums})
        open_, depth = [], deeper
        while level:
            t, p, d = level.pop()
            if sums.get((t, p, d), 0) <= leaf_rows or d == bits:
                leaves.setdefault(t, []).append((p, d))
            elif d == deeper:
                open_.append((t, p))
            else:
                level += [(t, 2 * p, d + 1), (t, 2 * p + 1, d + 1)]
    return leaves


def leaf_pairs(starts: np.ndarray, depths: np.ndarray, block: int, budget: int) -> np.ndarray:
    """Pairs (first <= second) of sorted leaves that agree in the top ``block`` bits, as far as both reach, and differ in
    at most ``budget`` bits of their common depth."""
    n, out = len(starts), [np.zeros((0, 2), np.int64)]
    if n == 1:
        return np.zeros((1, 2), np.int64)
    lo = 0
    while lo < n:
        hi = n if not block else max(lo + 1, int(np.searchsorted(starts, np.uint64(((int(starts[lo]) >> (64 - block)) + 1 << (64 - block)) - 1), side="right")))
        for at in range(lo, hi, 256):
            i = np.arange(at, min(hi, at + 256))
            common = np.minimum(depths[i][:, None], depths[None, lo:hi])
            differ = (starts[i][:, None] ^ starts[None, lo:hi]) >> (64 - common).astype(np.uint64)
            a, b = np.nonzero((np.bitwise_count(differ) <= budget) & (i[:, None] <= np.arange(lo, hi)[None]))
            out.append(np.stack([i[a], b + lo], 1))
        lo = hi
    return np.concatenate(out)


def _rotated(key: Column, by: int, bits: int) -> Column:
    """The top ``bits`` bits of ``key`` turned left."""
    turned = F.shiftleft(key, by).bitwiseOR(F.shiftrightunsigned(key, bits - by)) if by else key
    return turned if bits == 64 else turned.bitwiseAND(F.lit(-(1 << (64 - bits))))


def turns_of(total: int, leaf_rows: int, budget: int) -> int:
    """How many times a trie of ``total`` keys is built: once while that sends a key to no more groups than turns would.

    A turn walks nearly all of a trie again as long as its top is much shallower than a block of bits.
    """
    depth = max(0, -(-total // leaf_rows) - 1).bit_length()
    return 1 if sum(comb(depth, k) for k in range(budget + 1)) <= budget + 1 else budget + 1


def dealt(rows: DataFrame, keys_of: list[Column], bits: int, budget: int, leaf_rows: int, join, schema: str) -> DataFrame:
    """``join(rows of one group, the second leaf's first key or None)`` of every pair of leaves.

    ``rows`` has one key in each of ``keys_of``, whose top ``bits`` bits count; a group has its columns, ``key``, turned by
    ``by`` bits.  Leaves hold at most ``leaf_rows`` rows, or more if there would be more than about ``LEAVES``.
    """
    total = rows.count()
    leaf_rows = max(leaf_rows, total // LEAVES)
    turns = turns_of(total, leaf_rows, budget)
    width = bits // turns
    tries = [F.struct(F.lit(k * turns + r).alias("t"), F.lit(r * width).alias("by"), _rotated(s, r * width, bits).alias("key")) for k, s in enumerate(keys_of) for r in range(turns)]
    keys = rows.select("*", F.explode(F.array(*tries)).alias("__k")).select(*rows.columns, "__k.*")
    tops = Tops(trie_leaves(keys.select("t", "key"), bits, leaf_rows, len(tries)), len(tries), width if turns > 1 else 0, budget)
    shared = rows.sparkSession.sparkContext.broadcast(tops)  # a few numbers for each of a bounded number of leaves

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                own = tops.of(part["t"].to_numpy(np.int64), part["key"].to_numpy(np.int64).view(np.uint64))
                n = tops.width[own]
                row = np.repeat(np.arange(len(own)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield part.iloc[row].assign(pair=tops.flat[tops.first[own][row] + k])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shared.value.pairs[int(pdf["pair"].iloc[0])]
        return join(pdf, None if a == b else shared.value.begin[b])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", pair long"
    return keys.mapInPandas(deal, columns).groupBy("pair").applyInPandas(group, schema)


def trie_links(keys: DataFrame, budget: int, leaf_rows: int = 1 << 15) -> DataFrame:
    """Spanning links (a, b) of the graph on distinct long ``key`` values that differ in at most ``budget`` bits."""

    def join(pdf: pd.DataFrame, second: np.uint64 | None) -> pd.DataFrame:
        x, by = np.sort(pdf["key"].to_numpy(np.int64).view(np.uint64)), np.uint64(pdf["by"].iloc[0])
        forest = _Forest(len(x))
        cut = None if second is None else int(np.searchsorted(x, second))
        if cut != 0 and cut != len(x):
            walk(x, cut, 64, budget, lambda i, j: np.ones(len(i), bool), forest)
        linked = np.flatnonzero(forest.label != np.arange(len(x)))
        back = (x >> by) | (x << (np.uint64(64) - by)) if by else x
        return pd.DataFrame({"a": back[linked].view(np.int64), "b": back[forest.label[linked]].view(np.int64)})

    rows = keys.select(F.col("key").alias("whole"))
    return dealt(rows, [F.col("whole")], 64, budget, leaf_rows, join, "a long, b long")


def fingerprint_column(k: int):
    """A Pandas UDF: text to the 64-bit fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(fingerprints(texts[lo:hi], k)[:, 0].view(np.int64) for lo, hi in slices(texts, 4096))]))

    return fingerprint


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, leaf_rows: int = 1 << 15) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in at most ``budget`` bits are linked; the component is the smallest doc_id
    reachable.  A null or wordless text has fingerprint zero, linked like any other.  Repeated rows stay
    repeated.  A null doc_id never names a component unless all of it is null.  Empty in, empty out.
    """
    rows = materialise(docs.select("doc_id", fingerprint_column(shingle)(F.col("text")).alias("key")))
    named = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = materialise(trie_links(named, budget, leaf_rows))
    part = materialise(connected_components(links))
    about = part.join(named, part["node"] == named["key"]).select("key", "component", "least")
    inside = about.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    moved = materialise(join_spread(about.select("key", "component"), inside, "component", "members", part.count()).select(F.col("key").alias("node"), "component_id"))
    of = named.join(moved, named["key"] == moved["node"], "left").select("key", "n", F.coalesce("component_id", "least").alias("component_id"))
    joined = join_spread(rows, materialise(of), "key", "n", rows.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates of a given shingle similarity ---------------------------------------------------------


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words, mixed from the hashes of the words.

    A shorter text is one run; a text without words has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    run = min(k, n)
    h = np.full(n - run + 1, run, np.uint64)
    for i in range(run):
        h = (h ^ w[i : n - run + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(_mix(h, 1))


def expected_bits(similarity: float, bits: int) -> float:
    """Bits of ``bits`` in which two equally long texts of that Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits)


#: proposals of a task for one text among those neither near nor far, and neighbours looked at in a run of equal slices
NEAREST, RUN = 4, 32


class _Doubts:
    """Doubtful pairs, held where one of the two is among the other's nearest ``NEAREST``."""

    def __init__(self, forest: _Forest, at_once: int = 1 << 19) -> None:
        self.forest, self.at_once = forest, at_once
        self.held, self.new, self.size = np.zeros((0, 3), np.int64), [], 0

    def add(self, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        self.new.append(np.stack([i, j, far], 1).astype(np.int64))
        self.size += len(i)
        if self.size > self.at_once:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The held pairs that are still apart."""
        pairs = np.unique(np.concatenate([self.held, *self.new]), axis=0)
        pairs = pairs[self.forest.label[pairs[:, 0]] != self.forest.label[pairs[:, 1]]]
        row, which = np.r_[pairs[:, 0], pairs[:, 1]], np.tile(np.arange(len(pairs)), 2)
        order = np.lexsort((which, pairs[which, 2], row))
        first = np.r_[True, np.diff(row[order]) != 0] if len(row) else np.zeros(0, bool)
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
        keep = np.zeros(len(pairs), bool)
        keep[which[order][rank < NEAREST]] = True
        self.held, self.new, self.size = pairs[keep], [], 0
        return self.held[:, 0], self.held[:, 1]


def fingerprint_pairs(texts: DataFrame, similarity: float, lanes: int, slice_bits: int, slice_budget: int, leaf_rows: int) -> DataFrame:
    """Pairs (a, b) of distinct texts (``node`` long, ``lane0``.. longs) that their fingerprints propose as near duplicates.

    Each slice of ``slice_bits`` bits of the long fingerprint is one trie self-join.  Pairs that it finds are
    measured on the whole fingerprint: of those far below the distance expected at ``similarity`` a task proposes
    a spanning forest, of those around it each text's nearest ``NEAREST`` others, and of a long run of texts with one
    slice the neighbours in the order of their fingerprints.  Nothing is decided here: the caller compares the
    shingles of what is proposed, and the prefix join finds what is not.
    """
    total = 64 * lanes
    mean = expected_bits(similarity, total)
    spread = np.sqrt(mean * (1 - mean / total))
    sure_at, doubt_at = int(mean - 3.2 * spread), int(mean + 2.2 * spread)
    names = [f"lane{i}" for i in range(lanes)]

    def join(pdf: pd.DataFrame, second: np.uint64 | None) -> pd.DataFrame:
        x, every = pdf["key"].to_numpy(np.int64).view(np.uint64), np.stack([pdf[c].to_numpy(np.int64) for c in names], 1).view(np.uint64)
        order = np.lexsort((*every.T[::-1], x))
        x, every, node = x[order], every[order], pdf["node"].to_numpy(np.int64)[order]
        forest = _Forest(len(x))
        doubts = _Doubts(forest)

        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            far = np.bitwise_count(every[i] ^ every[j]).sum(1)
            doubt = (far > sure_at) & (far <= doubt_at)
            doubts.add(i[doubt], j[doubt], far[doubt])
            return far <= sure_at

        cut = None if second is None else int(np.searchsorted(x, second))
        if cut != 0 and cut != len(x):
            walk(x, cut, slice_bits, slice_budget, accept, forest, run=RUN)
        i, j = doubts.settle()
        i, j = np.concatenate([np.stack([i, j], 1), *forest.used]).T
        return pd.DataFrame({"a": node[i], "b": node[j]})

    parts = [_rotated(F.shiftleft(F.col(f"lane{lane}"), part * slice_bits), 0, slice_bits) for lane in range(lanes) for part in range(64 // slice_bits)]
    found = dealt(texts.select("node", *names), parts, slice_bits, slice_budget, leaf_rows, join, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


# --- the exact prefix join --------------------------------------------------------------------------------

#: cells of the shingle counts, and the pieces that they travel in
CELLS, PIECES = 1 << 22, 64
#: rows of a shingle beyond which they are dealt to several tasks
SPREAD_ROWS = 2_000


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def scan_texts(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """One pass over (doc_id, node, other, text): (doc_id, node, other, l) with the lanes of the fingerprint of each row's
    set of shingles, and rows (piece, counts) with each task's counts of shingles by a hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)

        def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
            for text in texts:
                h = shingle_set(text.as_py(), shingle)
                counts[_cells(h)] += np.uint32(1)
                yield h

        for batch in batches:
            n = batch.num_rows
            long = fingerprints_of(hashes(batch.column("text")), n, lanes).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, n * lanes + 1, lanes), pa.int32()), pa.array(long.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), batch.column("other"), held, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        parts = [(k, part) for k, part in enumerate(np.split(counts, PIECES)) if part.any()]
        if parts:
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array([k for k, _ in parts], pa.int32()),
                 pa.array([zlib.compress(part.tobytes(), 1) for _, part in parts], pa.binary())], names)

    names = ["doc_id", "node", "other", "l", "piece", "counts"]
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "node", "other", "text").mapInArrow(scan, f"doc_id {kind}, node long, other long, l array<long>, piece int, counts binary")


def shingle_levels(scanned: DataFrame, fan: int = 64) -> np.ndarray:
    """How common the shingles of each cell are, from 0 to 255 on a logarithmic scale; ``CELLS`` bytes.

    Counts of a piece are added up in rounds, about ``fan`` rows at a time, so no task holds those of all scans.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // PIECES, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pdf.iloc[:1][["piece"]].assign(counts=zlib.compress(np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32).tobytes(), 1))

    parts = scanned.where("piece is not null").select("piece", "counts")
    most = parts.groupBy("piece").count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        most = -(-most // fan)
        parts = parts.groupBy("piece", F.pmod(F.xxhash64("counts"), F.lit(most)).alias("block")).applyInPandas(lambda key, pdf: add(pdf), "piece int, counts binary")
    out = np.zeros((PIECES, CELLS // PIECES), np.uint8)
    for r in parts.groupBy("piece").applyInPandas(add, "piece int, counts binary").toLocalIterator():
        total = np.frombuffer(zlib.decompress(r.counts), np.uint32).astype(np.float64)
        out[r.piece] = np.minimum(255, np.round(8 * np.log2(total + 1))).astype(np.uint8)
    return out.ravel()


def with_text(pairs: DataFrame, texts: DataFrame, end: str, other: str, name: str, total: int) -> DataFrame:
    """``pairs`` with the text of the node at ``end``, as ``name``.

    A leader of very many pairs is dealt to several tasks by the ``other`` end, and its text copied once for each of them;
    such leaders, at most ten thousand, are sent as numbers.
    """
    bound = max(SPREAD_ROWS, total // 10_000)
    crowds = pairs.groupBy(F.col(end).alias("__node")).agg(F.count("*").alias("__n")).where(F.col("__n") > bound).select("__node", F.ceil(F.col("__n") / bound).alias("__parts"))
    crowds = F.broadcast(crowds)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = pairs.join(crowds, pairs[end] == F.col("__node"), "left").withColumn("__salt", F.pmod(F.xxhash64(other), parts)).drop("__node", "__parts")
    copied = texts.join(crowds, texts["node"] == F.col("__node"), "left").select(F.col("node").alias(end), F.col("text").alias(name), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__salt"))
    return dealt.join(copied, [end, "__salt"]).drop("__salt")


def prefix_rows(n, similarity: float):
    """How many of a text's ``n`` shingles, rarest first, must hold one that it shares with an alike text of its size or less."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def short_prefix_rows(n, similarity: float):
    """The same for an alike text of its size or more."""
    return n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1


def shared_prefixes(texts: DataFrame, shingle: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(token, salt, parts, node, n, pos, short): the shingles that two distinct texts or more (node, text) have in their prefixes.
    They travel packed: ``share`` is parts and salt, ``place`` n, pos and short.

    A text's ``n`` shingles are ordered from the rarest cell to the commonest.  Two texts of ``similarity`` or more
    share at least ``similarity * n`` of them, hence one of the first ``n - ceil(similarity * n) + 1``, whatever the
    cells' counts are; the one that is not larger has it in a ``short`` prefix.  Texts without words share one token.
    The rows of a shingle whose cell is very full are dealt to ``parts`` numbered by ``salt``.
    """
    load = np.maximum(0, 2 ** (levels / 8.0) - 1)
    full = max(SPREAD_ROWS, 8 * float(load.mean()))
    shared = texts.sparkSession.sparkContext.broadcast((levels, np.where(load > full, np.ceil(load / full), 1).astype(np.int32)[np.flatnonzero(load > full)], np.flatnonzero(load > full)))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, crowd, crowded = shared.value
        for pdf in batches:
            pdf = pdf.drop_duplicates("node")
            texts, nodes = pdf["text"].tolist(), pdf["node"].to_numpy(np.int64)
            for lo, hi in slices(texts):
                tokens, sizes, widths = [], [], []
                for text in texts[lo:hi]:
                    h = shingle_set(text, shingle)
                    n = len(h)
                    order = np.argsort(level[_cells(h)], kind="stable")[: int(prefix_rows(n, similarity))]
                    tokens.append(h[order] if n else np.zeros(1, np.uint64))
                    sizes.append(n)
                    widths.append(len(tokens[-1]))
                every, width, size = np.concatenate(tokens), np.array(widths), np.array(sizes, np.int64)
                pos = np.arange(len(every)) - np.repeat(np.cumsum(width) - width, width)
                node, cell = np.repeat(nodes[lo:hi], width), _cells(every)
                at = np.minimum(np.searchsorted(crowded, cell), max(0, len(crowded) - 1))
                parts = np.where(crowded[at] == cell, crowd[at], 1) if len(crowded) else np.ones(len(cell), np.int32)
                salt = (_mix(node.view(np.uint64), 3) % parts.astype(np.uint64)).astype(np.int32)
                place = np.repeat(size, width) << 32 | pos << 1 | (pos < np.repeat(short_prefix_rows(size, similarity), width))
                yield pd.DataFrame({"token": every.view(np.int64), "share": parts.astype(np.int64) << 32 | salt, "node": node, "place": place})

    def near(n, pos, short, node, m, at, brief, other) -> np.ndarray:
        """Whether pairs of rows of a token can be alike by their places in it."""
        first = (n < m) | ((n == m) & (node < other))
        most = np.minimum(n - pos, m - at)
        return np.where(first, short, brief) & (most >= similarity / (1 + similarity) * (n + m) - 1e-6)

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows, sorted by token, share, size and node, of tokens with several nodes or parts, each with two others that
        it can be like: the row before it, and the first of its token and size class.  Only the last row waits."""
        waiting, linked, known, anchor = None, False, None, None
        for pdf in batches:
            if waiting is not None:
                pdf = pd.concat([waiting, pdf])
            if not len(pdf):
                continue
            token, share, node = (pdf[c].to_numpy() for c in ("token", "share", "node"))
            like = (token[1:] == token[:-1]) & (share[1:] == share[:-1])
            new = np.r_[True, ~(like & (node[1:] == node[:-1]))]
            pdf = pdf[new]
            token, share, node, place = (pdf[c].to_numpy() for c in ("token", "share", "node", "place"))
            n, pos, short = place >> 32, (place & ((1 << 32) - 1)) >> 1, (place & 1).astype(bool)
            like = (token[1:] == token[:-1]) & (share[1:] == share[:-1])
            before, after = np.r_[linked, like], np.r_[like, False]
            size = np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity))
            starts = np.r_[True, ~(like & (size[1:] == size[:-1]))]
            lead = np.maximum.accumulate(np.where(starts, np.arange(len(n)), 0))
            whose = [x[lead] for x in (n, pos, short, node)]
            if known is not None:  # the row that waited: its others are known, its run began before
                for x, v in zip(whose, anchor):
                    x[lead == 0] = v
            one, two, leads = node.copy(), node.copy(), starts.copy()
            up = np.flatnonzero(like) + 1
            ok = near(n[up], pos[up], short[up], node[up], n[up - 1], pos[up - 1], short[up - 1], node[up - 1])
            one[up[ok]] = node[up[ok] - 1]
            ok = ~starts & near(n, pos, short, node, *whose)
            two[ok] = whose[3][ok]
            if known is not None:
                one[0], two[0], leads[0] = known
            keep = before | after | (share >> 32 > 1)
            out = pdf.assign(one=one, two=two, leads=leads)
            waiting, linked, known, anchor = pdf.iloc[-1:], bool(before[-1]), (one[-1], two[-1], leads[-1]), [x[-1] for x in whose]
            last = out.iloc[-1:]
            yield out[:-1][keep[:-1]]
        if waiting is not None and (linked or waiting["share"].iloc[0] >> 32 > 1):
            yield last

    schema = "token long, share long, node long, place long"
    spread = texts.mapInPandas(prefixes, schema).repartition("token", "share").sortWithinPartitions("token", "share", "place", "node")
    spread = spread.mapInPandas(repeated, schema + ", one long, two long, leads boolean")
    low = F.lit((1 << 32) - 1)
    return spread.select(
        "token", F.col("share").bitwiseAND(low).cast("int").alias("salt"), F.shiftright("share", 32).cast("int").alias("parts"), "node",
        F.shiftright("place", 32).cast("int").alias("n"), F.shiftright(F.col("place").bitwiseAND(low), 1).cast("int").alias("pos"), (F.col("place").bitwiseAND(F.lit(1)) == 1).alias("short"),
        "one", "two", "leads",
    )


def neighbour_pairs(prefixes: DataFrame, similarity: float) -> DataFrame:
    """A first proposal (a, b): in each token's texts, ordered by size, neighbours and the pairs with the first of a size
    class.  Of a token dealt to several parts those first ones are chained too: one row for each part and class.
    """
    ends = prefixes.select("node", F.explode(F.array("one", "two")).alias("there"))
    firsts = prefixes.where("parts > 1 and leads")
    by = W.partitionBy("token").orderBy("n", "node")
    here = F.struct("node", "n")
    chained = firsts.select("node", "n", F.lag(here).over(by).alias("before"), F.first(here).over(by).alias("first"))
    chained = chained.select("node", "n", F.explode(F.array("before", "first")).alias("t")).where("t is not null")
    alike = F.least("n", "t.n") >= similarity * F.greatest("n", "t.n") - 1e-9
    ends = ends.union(chained.where(alike).select("node", F.col("t.node").alias("there"))).where("node <> there")
    return ends.select(F.least("node", "there").alias("a"), F.greatest("node", "there").alias("b")).distinct()


def apart_pairs(prefixes: DataFrame, part: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different components (node, component) that can have ``similarity`` by their prefixes.

    The smaller of two alike texts has their first common shingle in its short prefix; nothing before that shingle is
    common, at most all from it on.  Of two components of a token's texts one is not its largest, so texts of the
    largest meet only those of the others, never each other.  A token dealt to parts meets the smaller side in each.
    """
    rows = materialise(prefixes.select("token", "salt", "parts", "node", "n", "pos", "short").join(part, "node", "left").select("token", "salt", "parts", "node", "n", "pos", "short", F.coalesce("component", "node").alias("g")))
    main = rows.groupBy("token", "g").count().groupBy("token").agg(F.max(F.struct("count", "g")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
    open_ = rows.join(main.select("token", F.col("m.g").alias("main")), "token").withColumn("few", F.col("g") != F.col("main"))
    open_ = materialise(open_.select("token", "salt", "parts", "node", "n", "pos", "short", "g", "few"))

    def met(many: DataFrame, few: DataFrame) -> DataFrame:
        """``few`` (spread over all parts of its tokens) against ``many``."""
        few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x, y = many.alias("x"), few.alias("y")
        before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
        fits = F.when(before, F.col("x.short")).otherwise(F.col("y.short"))
        most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        fits = fits & (most >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6) & (F.col("x.g") != F.col("y.g"))
        found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & fits)
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    short, rest, few = F.col("short"), ~F.col("short"), F.col("few")
    # a pair needs a short side: (short, not main) with all, and (short, main) with those that are neither
    pairs = met(open_, open_.where(few & short)).union(met(open_.where(~few & short), open_.where(few & rest)))
    return pairs.distinct()


def _name(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, slice_bits: int = 32,
                         slice_budget: int = 3, leaf_rows: int = 1 << 18, name=_name) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest doc_id (nulls last).

    Near duplicates share ``similarity`` of their sets of ``shingle``-word shingles, directly or through others;
    texts equal byte for byte always do.  Every link is a comparison of two shingle sets.  The tries of the long
    SimHash's slices and the shared prefixes propose a first lot; then every pair of different components that the
    prefixes allow is compared, so no pair of that similarity stays apart.  Texts without words are copies of each
    other.  Repeated rows count as copies.  All columns of ``docs`` are kept.  Texts are told apart by 128 bits: those
    that share the first 64 but not the others are named by the others.
    """
    plain = F.coalesce(F.col("text"), F.lit(""))
    first, other = name(plain)
    scanned = materialise(scan_texts(docs.select("doc_id", first.alias("node"), other.alias("other"), "text"), shingle, lanes))
    by_name = scanned.where("piece is null").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    shared = [r.node for r in by_name.where("lo <> hi").select("node").collect()]  # none, or a handful beyond 10**9 texts
    node = F.when(first.isin(shared), other).otherwise(first) if shared else first
    rows = scanned.where("piece is null")
    rows = rows.withColumn("node", F.when(F.col("node").isin(shared), F.col("other")).otherwise(F.col("node"))) if shared else rows
    named = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(F.col("l")[i]).alias(f"lane{i}") for i in range(lanes))))
    text_of = docs.select(node.alias("node"), "doc_id", "text")
    prefixes = materialise(shared_prefixes(text_of.select("node", "text"), shingle, similarity, shingle_levels(scanned)))

    # rows that repeat both id and text: few, or none
    again = rows.groupBy("node", "doc_id").count().where("count > 1").select(F.col("node").alias("__again"), F.col("doc_id").alias("__again_id"))
    again = materialise(again.join(named, (F.col("__again") == named["node"]) & F.col("__again_id").eqNullSafe(named["least"]), "left_semi"))
    repeats = not again.isEmpty()

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        known = lru_cache(64)(lambda text: shingle_set(text, shingle))
        out = []
        for x, y in zip(a, b):
            p, q = known(x), known(y)
            both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) else 0
            out.append(both >= similarity * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    def compared(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        # one row of each text: copies are told apart by their ids, so those of one text never meet in a task
        chosen = materialise(ends.join(named.select("node", "least"), "node"))
        theirs = (text_of["node"] == chosen["node"]) & text_of["doc_id"].eqNullSafe(chosen["least"])
        texts = text_of.join(chosen, theirs, "left_semi").select("node", "text")
        texts = materialise(texts.dropDuplicates(["node"]) if repeats else texts)
        total = pairs.count()
        both = with_text(with_text(pairs, texts, "a", "b", "ta", total), texts, "b", "a", "tb", total)
        return both.where(alike("ta", "tb")).select("a", "b")

    proposed = materialise(fingerprint_pairs(named, similarity, lanes, slice_bits, slice_budget, leaf_rows).union(neighbour_pairs(prefixes, similarity)).distinct())
    links = materialise(compared(proposed))
    part = materialise(connected_components(links))
    rest = materialise(apart_pairs(prefixes, part, similarity).join(proposed, ["a", "b"], "left_anti"))
    part = materialise(connected_components(links.union(compared(rest))))
    chosen = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("node")))
    groups = named.join(part.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("component", "node").alias("g"))
    stay = materialise(groups.groupBy("g").agg(chosen.alias("s")).select(F.col("s.node").alias("__node"), F.col("s.least").alias("__least")))
    node_name, id_name = unused(docs, "__node"), unused(docs, "__id")
    kept = docs.withColumns({node_name: node, id_name: F.col("doc_id")})
    kept = kept.join(stay, (kept[node_name] == stay["__node"]) & kept[id_name].eqNullSafe(stay["__least"]), "left_semi")
    release(scanned, prefixes, proposed)
    if not repeats:
        return kept.drop(node_name, id_name)
    same = (kept[node_name] == again["__again"]) & kept[id_name].eqNullSafe(again["__again_id"])
    once = kept.join(again, same, "left_semi").dropDuplicates([node_name, id_name])
    return kept.join(again, same, "left_anti").unionByName(once).drop(node_name, id_name)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, budget=2)
