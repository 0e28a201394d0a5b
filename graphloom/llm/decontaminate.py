"""Benchmark decontamination with an FM-index of each shard of documents.

A shard is an Arrow batch of documents.  Its words are numbered by the benchmark's vocabulary; a word that no
benchmark item has can be in no occurrence, so only runs of known words, at least as long as the shortest
window, enter the shard's index, each ended by a separator.  The index is a Burrows-Wheeler transform in a
wavelet matrix with sampled suffix positions.  All windows are searched backwards at once; occurrences are
located by walking to a sampled position; their spans are merged per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD_WORDS = 1 << 22
#: characters of the items whose windows a task holds at once, at most about; a larger benchmark goes round in several sets
SET_CHARS = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8, A-Z lower-cased: runs of digits, ASCII letters and anything beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


class FMIndex:
    """Backward search and location over an integer sequence; 0 is a separator and ends the sequence."""

    def __init__(self, seq: np.ndarray, sample: int = 16) -> None:
        n = len(seq)
        separators = seq == 0
        self.top = int(seq.max(initial=0))
        counts = np.bincount(seq, minlength=self.top + 1)
        self.before = np.r_[0, np.cumsum(counts)].astype(np.int64)  # rows of suffixes that begin with a smaller symbol
        suffixes = self._sorted_suffixes(seq, separators)
        self.bwt = seq[suffixes - 1]
        self.levels = []
        column = self.bwt
        for bit in range(self.top.bit_length() - 1, -1, -1):
            ones = (column >> bit) & 1
            rank = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, n - int(rank[-1])))
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        marked = (suffixes % sample == 0) | separators[suffixes - 1]  # run starts too: no walk crosses a separator
        self.marks = np.r_[0, np.cumsum(marked)].astype(np.int64)
        self.sampled = suffixes[marked]

    @staticmethod
    def _sorted_suffixes(seq: np.ndarray, separators: np.ndarray) -> np.ndarray:
        """Prefix doubling; every separator is a symbol of its own, so comparison never runs past one."""
        n = len(seq)
        rank = seq.astype(np.int64) + int(separators.sum())
        rank[separators] = np.arange(int(separators.sum()))
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:
            ahead = np.full(n, -1, np.int64)
            ahead[: max(0, n - width)] = rank[width:]
            key = rank * (n + int(rank.max()) + 2) + ahead + 1 if width == 1 else rank * (n + 1) + ahead + 1
            # only rows whose rank is shared move; the others keep their place
            at = rank[order]
            shared = np.r_[False, at[1:] == at[:-1]] | np.r_[at[1:] == at[:-1], False]
            part = order[shared]
            order[shared] = part[np.argsort(key[part], kind="stable")]
            k = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
            rank = new
            if int(rank.max(initial=0)) == n - 1:
                return order
            width *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is in the transform before ``row``."""
        low, high = np.zeros(len(row), np.int64), row.astype(np.int64)
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern; a pattern ends its row of ``patterns``."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for step in range(1, width + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - step]
            known = symbol <= self.top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.before[symbol] + self.rank(symbol, low[live]), self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            done = self.marks[at + 1] > self.marks[at]
            out[left[done]] = self.sampled[self.marks[at[done]]] + steps[left[done]]
            left = left[~done]
            symbol = self.bwt[rows[left]]
            rows[left] = self.before[symbol] + self.rank(symbol, rows[left])
            steps[left] += 1
        return out


class Windows:
    """The benchmark's distinct windows, right-aligned in a matrix of word numbers, and the items that have each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = 10) -> None:
        self.number: dict[bytes, int] = {}
        names = sorted({str(item) for item, _ in items})
        place = {x: k for k, x in enumerate(names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.zeros(max(window, len(words)), np.int32)  # a shorter item stands at the end of its row, after zeros
            ids[len(ids) - len(words) :] = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(rows[-1]), place[str(item)], np.int32))
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(of.ravel().astype(np.int64) * max(1, len(names)) + np.concatenate(owners))
        self.flat = pairs % max(1, len(names))
        self.widths = np.bincount(pairs // max(1, len(names)), minlength=len(self.patterns)).astype(np.int64)
        self.first = np.cumsum(self.widths) - self.widths
        self.lengths = (self.patterns > 0).sum(1)
        self.items = names

    def scan(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per document of word numbers: the positions of hit words, and the numbers of the items that occur."""
        nothing = np.zeros(0, np.int64)
        hits, items = [nothing] * len(docs), [nothing] * len(docs)
        if not len(self.lengths) or not docs:
            return hits, items
        shortest = int(self.lengths.min())
        whole = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))])
        begin = np.r_[0, np.cumsum([len(d) + 1 for d in docs])].astype(np.int64)
        edge = np.diff(np.r_[0, (whole > 0).astype(np.int8), 0])
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_enough = hi - lo >= shortest
        lo, hi = lo[long_enough], hi[long_enough]
        if not len(lo):
            return hits, items
        size = hi - lo + 1  # the word after a run is unknown: it becomes the separator
        at = np.repeat(lo, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        index = FMIndex(whole[at].astype(np.int64))
        low, high = index.search(self.patterns, self.lengths)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return hits, items
        rows = np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        place = at[index.locate(rows)]
        delta = np.zeros(len(whole) + 1, np.int32)
        np.add.at(delta, place, 1)
        np.add.at(delta, place + self.lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(delta)[:-1] > 0)
        doc = np.searchsorted(begin, hit, side="right") - 1
        for d, part in zip(*_split(doc, hit)):
            hits[d] = part - begin[d]
        own = np.repeat(np.searchsorted(begin, place, side="right") - 1, self.widths[which])
        k = np.arange(len(own)) - np.repeat(np.cumsum(self.widths[which]) - self.widths[which], self.widths[which])
        item = self.flat[np.repeat(self.first[which], self.widths[which]) + k]
        pairs = np.unique(own * len(self.items) + item)
        for d, part in zip(*_split(pairs // len(self.items), pairs % len(self.items))):
            items[d] = part
        return hits, items


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted ``keys`` and the values of each."""
    names, first = np.unique(keys, return_index=True)
    return names, np.split(values, first[1:])


def item_pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text): items beyond ``most`` characters in runs of words of about that many, which overlap by one word less
    than a window, so that each window lies whole in one of them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words = words_of(text)
                step = max(window, most * len(words) // max(1, sum(map(len, words)) + len(words)))
                for at in range(0, max(1, len(words) - window + 1), step):
                    yield pd.DataFrame({"item_id": [item], "text": [b" ".join(words[at : at + step + window - 1]).decode("utf-8", "replace")]})

    long = F.length("text") > most
    return items.where(~long).unionByName(items.where(long).mapInPandas(split, "item_id string, text string"))


def window_sets(benchmark: DataFrame, window: int = 10, set_chars: int = SET_CHARS) -> Iterator[tuple[Windows, bool]]:
    """Windows of the benchmark, a stated query set, in sets of items of about ``set_chars`` characters at most, and
    whether a set is the last.

    Items without id or text take no part; repeated items count once.  An item longer than a quarter of a set is split
    between its words.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    sets = max(1, -(-2 * (items.agg(F.sum(F.length("text"))).first()[0] or 0) // set_chars)) if set_chars else 1
    if sets > 1:
        items = materialise(item_pieces(items, window, max(1, set_chars // 4)))
    for k in range(sets):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k) if sets > 1 else items
        yield Windows([tuple(r) for r in mine.collect()], window), k == sets - 1


def load_windows(benchmark: DataFrame, window: int = 10) -> Windows:
    """All windows of a benchmark that fits in one set."""
    return next(window_sets(benchmark, window, 0))[0]


def _shards(texts: list[str | None], windows: Windows) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of documents of about ``SHARD_WORDS`` words, as word numbers, with the place of the first."""
    held, n, start, get = [], 0, 0, windows.number.get
    for k, text in enumerate(texts):
        words = words_of(text)
        held.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        n += len(words)
        if n >= SHARD_WORDS:
            yield start, held
            held, n, start = [], 0, k + 1
    if held:
        yield start, held


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, set_chars: int = SET_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one; a document word inside
    any occurrence is hit.  A null or wordless text has no words and no hits; repeated rows are each reported;
    with an empty benchmark nothing is hit.  A benchmark of several sets is searched set by set: each row carries the
    hit spans and the items found so far to the next.
    """
    rows = docs.select("doc_id", "text").withColumns({"spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")})

    def scan(shared, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            windows = shared.value
            for pdf in batches:
                texts = pdf["text"].tolist()
                for start, shard in _shards(texts, windows):
                    part, spans, items, sizes = pdf.iloc[start : start + len(shard)], [], [], []
                    for words, hit, item, old, named in zip(shard, *windows.scan(shard), part["spans"], part["items"]):
                        spans.append(merged(np.asarray(old, np.int64), hit) if len(hit) else old)
                        items.append(sorted({*named, *(windows.items[i] for i in item)}) if len(item) else named)
                        sizes.append(len(words))
                    yield part.assign(spans=spans, items=items, n_words=sizes)[columns]

        return run

    for windows, last in window_sets(benchmark, window, set_chars):
        shared = docs.sparkSession.sparkContext.broadcast(windows)  # about ``set_chars`` characters' windows
        out = rows.drop("text") if last else rows  # texts go on only to another set
        rows = rows.mapInPandas(scan(shared, out.columns), out.schema)
        rows = rows if last else materialise(rows)
    # spans are sorted ends: first word, word after the last, and so on
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_join("items", ",")
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def merged(spans: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Flat sorted spans (first, after the last, ...) with the sorted positions ``hit`` taken in."""
    cut = np.flatnonzero(np.diff(hit) > 1)
    more = np.stack([hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]] + 1], 1)
    every = np.concatenate([spans.reshape(-1, 2), more])
    every = every[np.argsort(every[:, 0], kind="stable")]
    reach = np.maximum.accumulate(every[:, 1])
    new = np.r_[True, every[1:, 0] > reach[:-1]]
    return np.stack([every[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(every) - 1]]], 1).ravel()


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without the merged spans of its hit words."""
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    first = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
    kept, at = [], 0
    for lo, hi in zip(first, np.r_[first[1:], len(hit)]):
        kept.append(raw[at : spans[hit[lo]][0]].rstrip())
        at = spans[hit[hi - 1]][1]
        if at < len(raw) and not raw[at : at + 1].isspace() and kept[-1]:
            kept.append(b" ")
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "replace").strip() if kept else text


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, set_chars: int = SET_CHARS) -> DataFrame:
    """``docs`` with every benchmark occurrence cut out of ``text`` and ``n_chars``, where there, set anew.

    Cutting can bring words together that form another window; documents are scanned until none is left, with a
    benchmark of several sets until a whole round over them cuts nothing.  Rows without a hit, null texts among them,
    are left as they are.
    """

    def cleaner(shared):
        @F.pandas_udf("string")
        def clean(text: pd.Series) -> pd.Series:
            windows, out = shared.value, text.tolist()
            todo = list(range(len(out)))
            while todo:
                again = []
                for start, shard in _shards([out[i] for i in todo], windows):
                    hits, _ = windows.scan(shard)
                    for k, hit in enumerate(hits):
                        if len(hit):
                            i = todo[start + k]
                            out[i] = _cut(out[i], hit)
                            again.append(i)
                todo = again
            return pd.Series(out, dtype=object)

        return clean

    spark, before, cleaned, sets = docs.sparkSession, docs, docs, 0
    while True:
        for windows, _ in window_sets(benchmark, window, set_chars):
            clean = cleaner(spark.sparkContext.broadcast(windows))
            sets += 1
            cleaned = (materialise(cleaned) if sets > 1 else cleaned).withColumn("text", clean("text"))
        if sets == 1:
            break
        cleaned = materialise(cleaned)
        known = lambda df: df.agg(F.sum(F.length("text")), F.count("*")).first()
        if known(cleaned) == known(before):  # cutting only shortens
            break
        before = cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
