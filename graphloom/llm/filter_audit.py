"""Filter interaction audit: what each of five document filters removes, in every order in which they can be applied."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialise, table

FILTERS = "ABCDE"
A, B, C, D, E = 1, 2, 4, 8, 16
#: bytes of text that are scanned at once; a longer text goes in pieces that end at white space
PIECE = 1 << 22
#: words beyond this length are compared as a whole, shorter ones eight bytes at a time
LONG_WORD = 64


def _bytes_in(spec: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(spec)] = True
    return found


SPACE, CAPITAL, SYMBOL = _bytes_in(b"\x20\x09\x0a\x0b\x0c\x0d"), _bytes_in(bytes(range(65, 91))), _bytes_in(b"#$%&*|")
#: every code point has one byte that is no continuation
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Scanner:
    """Word counts, distinct words and byte classes of texts that lie one after another in a byte buffer."""

    def __init__(self, data: np.ndarray, piece: int = PIECE):
        self.data, self.piece = data, piece
        self._up, self._down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes modulo 2^64 of words, from one prefix sum over all bytes."""
        if len(self._up) < len(raw):
            n = max(len(raw), min(self.piece, len(self.data)))
            self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._up[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self._down[starts]

    def words(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and hash of every word of the texts between neighbouring ``bounds``, in order."""
        lo, hi = int(bounds[0]), int(bounds[-1])
        raw = self.data[lo:hi]
        solid = ~SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = bounds[(bounds > lo) & (bounds < hi)] - lo
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return starts + lo, ends - starts, self.hashes(raw, starts, ends)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words of ``size`` bytes at ``a`` and ``b`` are equal, byte by byte."""
        equal, left = np.ones(len(a), bool), np.arange(len(a))
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data[int(min(a.min(), b.min())) : int((np.maximum(a, b) + size).max())], np.zeros(8, np.uint8)]), 8) if len(a) else None
        base = int(min(a.min(), b.min())) if len(a) else 0
        for done in range(0, LONG_WORD, 8):
            left = left[equal[left] & (size[left] > done)]
            if not len(left):
                return equal
            rest = np.minimum(size[left] - done, 8).astype(np.uint64)
            mask = np.where(rest == 8, ~np.uint64(0), (np.uint64(1) << (rest % np.uint64(8) * np.uint64(8))) - np.uint64(1))
            x, y = (np.ascontiguousarray(windows[p[left] - base + done]).view("<u8")[:, 0] for p in (a, b))
            equal[left] = (x ^ y) & mask == 0
        for k in left[equal[left] & (size[left] > LONG_WORD)]:
            equal[k] = self.data[a[k] : a[k] + size[k]].tobytes() == self.data[b[k] : b[k] + size[k]].tobytes()
        return equal

    def _repeats(self, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by owner and hash: which words repeat the one before, and which share its hash but not its bytes."""
        order = np.lexsort((hashes, owner))
        alike = np.zeros(len(order), bool)
        alike[1:] = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        at = np.flatnonzero(alike)
        one, two = order[at], order[at - 1]
        proven = sizes[one] == sizes[two]
        proven[proven] = self.same(starts[one[proven]], starts[two[proven]], sizes[one[proven]])
        repeat, clash = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeat[one[proven]], clash[one[~proven]] = True, True
        return repeat, clash

    def _exact(self, lo: int, hi: int) -> int:
        return len(set(self.data[lo:hi].tobytes().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")) - {b""})

    def _run(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes, hashes = self.words(bounds)
        owner = np.searchsorted(bounds, starts, side="right") - 1
        repeat, clash = self._repeats(starts, sizes, hashes, owner)
        n = len(bounds) - 1
        words = np.bincount(owner, minlength=n)
        distinct = words - np.bincount(owner[repeat], minlength=n)
        for k in np.unique(owner[clash]):
            distinct[k] = self._exact(int(bounds[k]), int(bounds[k + 1]))
        return words, distinct

    def _long(self, lo: int, hi: int) -> tuple[int, int]:
        """Of one long text: pieces end at white space, and only distinct words are kept from piece to piece."""
        total, kept, merged = 0, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)], 0
        at = lo
        while at < hi:
            end = min(at + self.piece, hi)
            while end < hi:
                gap = np.flatnonzero(SPACE[self.data[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                    break
                end = min(end + self.piece, hi)
            found = self.words(np.array([at, end]))
            total += len(found[0])
            kept = [np.concatenate(x) for x in zip(kept, found)]
            if end == hi or len(kept[0]) > 2 * merged + self.piece // 8:
                repeat, clash = self._repeats(*kept, np.zeros(len(kept[0]), np.int64))
                if clash.any():
                    return total + self._count(end, hi), self._exact(lo, hi)
                kept = [x[~repeat] for x in kept]
                merged = len(kept[0])
            at = end
        return total, len(kept[0])

    def _count(self, at: int, hi: int) -> int:
        """Words from ``at``, a word's border, to ``hi``."""
        n, inside = 0, False
        for lo in range(at, hi, self.piece):
            solid = ~SPACE[self.data[lo : min(lo + self.piece, hi)]]
            n += int((solid[1:] & ~solid[:-1]).sum()) + bool(solid[0] and not inside)
            inside = bool(solid[-1])
        return n

    def counts(self, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """words, distinct, capitals, points (code points) and symbols of each text between neighbouring ``bounds``."""
        n = len(bounds) - 1
        out = {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "points", "symbols")}
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + self.piece, side="right")) - 1)
            own, part = bounds[start : stop + 1], slice(start, stop)
            lo, hi = int(own[0]), int(own[-1])
            for at in range(lo, hi, self.piece):
                raw = self.data[at : min(at + self.piece, hi)]
                cut = np.clip(own - at, 0, len(raw))
                for name, kind in (("capitals", CAPITAL), ("points", LEAD), ("symbols", SYMBOL)):
                    sums = np.zeros(len(raw) + 1, np.int32)
                    np.cumsum(kind[raw], out=sums[1:])
                    out[name][part] += np.diff(sums[cut])
            if stop == start + 1 and hi - lo > self.piece:
                out["words"][start], out["distinct"][start] = self._long(lo, hi)
            elif hi > lo:
                out["words"][part], out["distinct"][part] = self._run(own)
            start = stop
        return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the bounds of its texts in them; nothing is copied where no text is null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds.astype(np.int64)


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the failed conditions A to D."""
    return (
        A * (counts["words"] < 200) + B * (100 * counts["distinct"] < 50 * counts["words"])
        + C * (100 * counts["capitals"] > 2 * counts["points"]) + D * (counts["symbols"] > 0)
    ).astype(np.int32)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (failed conditions A to D) and SHA-256 of the text of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            mask = failed(Scanner(data).counts(bounds))
            view = memoryview(data)
            digests = [hashlib.sha256(view[lo:hi]).digest() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(scan, f"doc_id {kind}, part string, mask int, digest binary")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1) by doc_id; of several labels of one id the largest counts.  Only ids that have one are joined."""
    marked = (
        labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 or toxic = 1")
    )
    none = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    joined = rows.where(F.col("doc_id").isNotNull()).join(marked, "doc_id", "left").select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return joined.unionByName(rows.where(F.col("doc_id").isNull()).select("*", *none))


def fail_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (failed conditions A to E), n, good, toxic: documents by part and exact set of failed filters.

    Rows meet by (text, id) first and by text only after rows of one part, mask and label are added up, so copies of one
    text are never gathered.
    """
    # texts are scanned once; the few bytes a row that are left are read by both branches below
    each = with_labels(materialise(scanned(docs)).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), labels)
    groups = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"),
        # null ids are neither smaller nor larger than others
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))["n"].alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    passed = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = groups.withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", passed.alias("n")), F.struct((F.col("mask") + E).alias("mask"), (F.col("n") - passed).alias("n")))).alias("cell")
    )
    n = F.col("cell.n")
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _sum(value: str, where: str) -> Column:
    return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({where}, {value}, 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The effect of each filter at each place of all 120 orders, by source.

    ``docs`` has doc_id, text and source, ``labels`` has doc_id, quality and toxic.  A null text is empty, a null source the
    empty string; a null id has no labels and takes no part in condition E (no row is identical to a *smaller* id because
    of it).  Repeated rows of one id all count, and none of them fails E because of another.  No documents give no rows.
    """
    bit = "shiftleft(1, ascii({}) - ascii('A'))"
    parts = fail_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    # 120 orders of 5 steps are made into rows for each part, of which there are as many as sources
    orders = F.split(F.lit(",".join("".join(order) for order in permutations(FILTERS))), ",")
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = rows.withColumn("bit", F.expr(bit.format("substring(filter_order, step, 1)"))).withColumn(
        "before", F.expr(f"aggregate(regexp_extract_all(substring(filter_order, 1, step - 1), '.', 0), 0, (s, x) -> s + {bit.format('x')})")
    )
    here = "(c.mask & before) = 0 and (c.mask & bit) <> 0"
    return rows.select(
        "part", "filter_order", "step",
        _sum("c.n", "(c.mask & (before | bit)) = 0").alias("kept"), _sum("c.n", here).alias("removed"),
        _sum("c.n", "(c.mask & before) <> 0 and (c.mask & bit) <> 0").alias("redundant"), _sum("c.n", "c.mask = bit").alias("unique_fails"),
        _sum("c.good", here).alias("good_lost"), _sum("c.toxic", here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        _sum("c.n * (120 div bit_count(c.mask))", "(c.mask & bit) <> 0").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
