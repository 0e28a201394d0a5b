"""Language-model scores from Brown class-based bigrams.

Every word of the training texts has a class, found by exchange: a word goes to the class that raises the likelihood
of the class bigrams most.  The most frequent words, and the endings of all others taken as words, are clustered one
by one, in turns.  Then all other words, each with the counts of the classes before it, move from the class of their
ending to their own best class, all at once against the same class bigrams, so that this step is spread over the
cluster however many words there are.

A token's probability is P(class | class before) * P(word | class).  What stands before conditions by the class of its
symbol: a frequent word's own class, any other word's ending's.  Transitions are smoothed with the class frequencies;
counts inside a class are discounted, and the discounts go to an unknown word of that class.  The end of a text is a
class of its own.

Counts come from all training texts: one pass counts words, one the bigrams of symbols, and one, over all texts,
writes down what each token follows: numbers of the most frequent words, of bounded number, and the other words as
they are, to be joined with the full word table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold_is, materialise, release, slices, table

CLUSTERED = 1024
CLASSES = 64
ENDINGS = 256
#: words that every task knows by number; the others are joined
HELD = 200_000
#: distinct words that a counting task holds before it passes them on
TALLY = 500_000
SMOOTHING = 20.0
#: words of a text that are not held up to which they go on one by one
FEW_OTHERS = 256
END = " "


def ending(word: bytes) -> int:
    """Number of a word's ending: a hash of its last letters and of whether a mark follows them."""
    bare = word.rstrip(b".,;:!?\"')]}%&$#*|")
    return zlib.crc32(bare[-2:] + (b"|" if len(bare) < len(word) else b"")) % ENDINGS


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of the column ``text``; the end of a text counts as the word ``END``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_text(list(tally)), pa.array(np.fromiter(tally.values(), np.int64, len(tally)))], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                tally.update(words_of(text.as_py()))
                tally[END.encode()] += 1
                if len(tally) > TALLY:
                    yield out()
                    tally.clear()
        if tally:
            yield out()

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _text(words: list[bytes]) -> pa.Array:
    """Words, which are UTF-8, as an array of texts."""
    return pa.array(words, pa.binary()).cast(pa.string())


class _Numbers(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def frequent_words(vocab: DataFrame, most: int) -> list[tuple[str, int]]:
    """(word, c) of at most ``most`` words: all with a count above a threshold, most frequent first."""
    vocab = vocab.where(F.col("word") != END)
    sizes, total, least = vocab.where("c > 1").groupBy("c").count().orderBy(F.desc("c")).limit(most).collect(), 0, None
    for r in sizes:
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r.c
    if least is None:
        found = vocab.orderBy(F.desc("c"), "word").limit(min(most, CLUSTERED)).collect()
    else:
        found = vocab.where(F.col("c") >= least).collect()
    return sorted(((r.word, r.c) for r in found), key=lambda r: (-r[1], r[0]))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of each symbol: the first ``words`` symbols are clustered into ``classes``, each other one is its own."""
    symbols = len(bigrams)
    fixed = symbols - words
    of = np.r_[np.arange(words) % max(1, classes), classes + np.arange(fixed)].astype(np.int64)
    groups = classes + fixed
    onto = np.zeros((symbols, groups))
    onto[np.arange(symbols), of] = 1
    out, into = bigrams[:words] @ onto, (onto.T @ bigrams[:, :words]).T  # word to class, class to word
    n = onto.T @ bigrams @ onto
    rows, cols = n.sum(1), n.sum(0)
    for _ in range(sweeps):
        moves = 0
        for w in range(words):
            a, own = of[w], bigrams[w, w]
            r, c = out[w].copy(), into[w].copy()
            r[a] -= own
            c[a] -= own
            n[a] -= r
            n[:, a] -= c
            n[a, a] -= own
            rows[a] -= r.sum() + own
            cols[a] -= c.sum() + own
            rows -= c
            cols -= r
            top, side = n[:classes], n[:, :classes]
            gain_row, gain_col = _f(top + r) - _f(top), _f(side + c[:, None]) - _f(side)
            k = np.arange(classes)
            gain = gain_row.sum(1) - gain_row[k, k] + gain_col.sum(0) - gain_col[k, k] + _f(n[k, k] + r[:classes] + c[:classes] + own) - _f(n[k, k])
            total_r, total_c = r.sum() + own, c.sum() + own
            # class k's outgoing total also takes the bigrams into the word from its own members
            gain -= _f(rows[:classes] + total_r + c[:classes]) - _f(rows[:classes] + c[:classes]) + _f(cols[:classes] + total_c + r[:classes]) - _f(cols[:classes] + r[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += r
            n[:, b] += c
            n[b, b] += own
            rows[b] += r.sum() + own
            cols[b] += c.sum() + own
            rows += c
            cols += r
            if b != a:
                of[w] = b
                moves += 1
                for side_, counts in ((out, bigrams[:words, w]), (into, bigrams[w, :words])):
                    side_[:, a] -= counts
                    side_[:, b] += counts
        if not moves:
            break
    return of


class Lexicon:
    """Numbers of the held words (the end of a text is the last) and symbols: core words, endings, the end."""

    def __init__(self, held: list[tuple[str, int]], core: int, ends: int, n: int, v: int) -> None:
        self.number = _Numbers({w.encode(): k for k, (w, _) in enumerate(held)})
        self.held, self.core, self.n, self.v = len(held) + 1, core, n, v
        self.counts = np.array([*(c for _, c in held), ends], np.float64)
        self.symbols = core + ENDINGS + 1
        self.symbol = np.array([*(k if k < core else core + ending(w.encode()) for k, (w, _) in enumerate(held)), self.symbols - 1], np.int64)
        self.base = np.log10((self.counts + 1) / (n + v + 1))

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers among the held words (-1: not held) and symbols of a text's words and its end."""
        held = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        symbol = self.symbol[held]
        other = np.flatnonzero(held < 0)
        symbol[other] = np.fromiter((self.core + ending(words[k]) for k in other.tolist()), np.int64, len(other))
        return np.r_[held, self.held - 1], np.r_[symbol, self.symbols - 1]


def _bigrams(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Counts of symbol pairs over all texts; at most the square of the number of symbols come back."""
    size = lexicon.symbols
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, total = shared.value, np.zeros(size * size, np.int64)
        for pdf in batches:
            pairs, n = [], 0
            for text in pdf["text"]:
                symbol = lexicon.read(words_of(text))[1]
                pairs.append(np.r_[size - 1, symbol[:-1]] * size + symbol)
                n += len(symbol)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(pairs), minlength=size * size)
                    pairs, n = [], 0
            if pairs:
                total += np.bincount(np.concatenate(pairs), minlength=size * size)
        code = np.flatnonzero(total)
        if len(code):
            yield pd.DataFrame({"code": code, "n": total[code]})

    out = np.zeros(size * size)
    pairs = texts.select("text").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # rows of the matrix come packed, so that the driver never holds them as objects
    by_row = pairs.groupBy(F.floor(F.col("code") / size).alias("a")).agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("n"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"codes": [np.asarray(c, np.int64).tobytes() for c in pdf["codes"]], "n": [np.asarray(n, np.int64).tobytes() for n in pdf["n"]]})

    for r in by_row.mapInPandas(pack, "codes binary, n binary").toLocalIterator():
        out[np.frombuffer(r.codes, np.int64)] = np.frombuffer(r.n, np.int64)
    return out.reshape(size, size)


OCCURRENCES = "row long, doc_id long, n_tokens long, n_known long, base double, codes array<int>, word string, a int, k long, learns boolean, code int"


def occurrences(docs: DataFrame, lexicon: Lexicon, of: np.ndarray, learns: Column) -> DataFrame:
    """What each token follows, in three kinds of rows.

    One row a text: doc_id, n_tokens, n_known and base of its held words, and the codes of its held words: class before
    times ``lexicon.held`` plus the word's number.  One for each other word in it and class before it: word, a, k.
    And the counts k of the codes of the texts that the model learns from.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, of))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lexicon, of), row = shared.value, TaskContext.get().partitionId() << 36
        tallied, held_codes, n_codes = np.zeros((2, 0), np.int64), [], 0

        def tally() -> np.ndarray:
            new = np.stack(np.unique(np.concatenate([np.zeros(0, np.int64), *held_codes]), return_counts=True))
            if not tallied.size:
                return new
            code, at = np.unique(np.r_[tallied[0], new[0]], return_inverse=True)
            return np.stack([code, np.bincount(at, weights=np.r_[tallied[1], new[1]], minlength=len(code)).astype(np.int64)])

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(arrays, schema)], schema=schema)

        for batch in batches:
            ids, texts, learn = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in slices(texts, 256):
                tokens, known, bases, codes = [], [], [], []
                tail_words, tail_rows = [], []  # words that are not held; row, class before, count and whether it is learnt from
                for at in range(lo, hi):
                    words = words_of(texts[at])
                    held, symbol = lexicon.read(words)
                    before = of[np.r_[lexicon.symbols - 1, symbol[:-1]]]
                    mine = held >= 0
                    own = before[mine] * lexicon.held + held[mine]
                    tokens.append(len(held))
                    known.append(int(mine.sum()) - (lexicon.counts[-1] == 0))
                    bases.append(float(lexicon.base[held[mine]].sum()))
                    codes.append(own)
                    if learn[at]:
                        held_codes.append(own)
                        n_codes += len(own)
                    other = np.flatnonzero(~mine)
                    if len(other) <= FEW_OTHERS:
                        tail_words += [words[i] for i in other.tolist()]
                        tail_rows.append(np.stack([np.full(len(other), row), before[other], np.ones(len(other), np.int64), np.full(len(other), int(learn[at]))]))
                    else:  # a long text may repeat a word at will: its repeats are counted here
                        found = Counter(zip([words[i] for i in other.tolist()], before[other].tolist()))
                        tail_words += [w for w, _ in found]
                        tail_rows.append(np.array([[row, a, k, int(learn[at])] for (_, a), k in found.items()]).T)
                    row += 1
                sizes = np.array([len(c) for c in codes])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(codes).astype(np.int32)))
                yield batch_of(hi - lo, row=pa.array(np.arange(row - (hi - lo), row)), doc_id=ids.slice(lo, hi - lo), n_tokens=pa.array(tokens), n_known=pa.array(known), base=pa.array(bases), codes=lists)
                if tail_words:
                    r, a, k, l = np.concatenate(tail_rows, axis=1)
                    yield batch_of(len(r), row=pa.array(r), word=_text(tail_words), a=pa.array(a), k=pa.array(k), learns=pa.array(l.astype(bool)))
                if n_codes > 1 << 20:
                    tallied, held_codes, n_codes = tally(), [], 0
        if held_codes or tallied.size:
            tallied = tally()
        for at in range(0, tallied.shape[1], 1 << 17):
            code, n = tallied[:, at : at + (1 << 17)]
            yield batch_of(len(code), code=pa.array(code), k=pa.array(n))

    long, text = pa.int64(), pa.string()
    kinds = {"row": long, "doc_id": long, "n_tokens": long, "n_known": long, "base": pa.float64(), "codes": pa.list_(pa.int32()), "word": text, "a": pa.int32(), "k": long, "learns": pa.bool_(), "code": pa.int32()}
    schema = pa.schema(list(kinds.items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    return rows.mapInArrow(read, OCCURRENCES)


def best_classes(first: np.ndarray, contexts: list, counts: list, moves: np.ndarray, classes: int) -> np.ndarray:
    """The class each word is best in, of the first ``classes``, by the likelihood of the class bigrams ``moves`` (class
    before x class), which hold the word in its class ``first``; it follows ``contexts`` so often as ``counts`` say."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes) - sizes
    a, n = np.concatenate(contexts).astype(np.int64), np.concatenate(counts).astype(np.float64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    onto, total = moves[:, :classes], moves[:, :classes].sum(0)
    one = _f(onto + 1) - _f(onto)
    gain = one[a]
    more = np.flatnonzero(n != 1)
    gain[more] = _f(onto[a[more]] + n[more, None]) - _f(onto[a[more]])
    own = first[word]
    here = onto[a, own]
    gain[np.arange(len(a)), own] = _f(here) - _f(np.maximum(here - n, 0))  # without the word's own counts
    whole = np.add.reduceat(gain, starts, axis=0)
    t = np.add.reduceat(n, starts)
    loss = _f(total + t[:, None]) - _f(total)
    k = np.arange(len(sizes))
    loss[k, first] = _f(total[first]) - _f(np.maximum(total[first] - t, 0))
    return (whole - loss).argmax(1)


def _assigned(vectors: DataFrame, key: str, lexicon: Lexicon, of: np.ndarray, moves: np.ndarray, classes: int) -> DataFrame:
    """(key, c, z, ctx, n) of words (key, v: array of a, k): count, class and counts by class before."""
    shared = vectors.sparkSession.sparkContext.broadcast((lexicon, of, moves))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, of, moves = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                if key == "word":
                    first = np.array([of[lexicon.core + ending(w.encode())] for w in part[key]], np.int64)
                else:
                    first = of[lexicon.symbol[part[key].to_numpy(np.int64)]]
                found, ctx, n = first.copy(), part["ctx"].tolist(), part["n"].tolist()
                move = np.arange(len(part)) if key == "word" else np.flatnonzero(part[key].to_numpy(np.int64) >= lexicon.core)
                move = move[first[move] < classes]
                if len(move):  # core words and the end keep their classes
                    found[move] = best_classes(first[move], [ctx[i] for i in move], [n[i] for i in move], moves, classes)
                yield part.assign(c=[int(np.sum(x)) for x in n], z=found.astype(np.int32))[[key, "c", "z", "ctx", "n"]]

    kind = vectors.schema[key].dataType.simpleString()
    lists = vectors.select(key, F.transform("v", lambda x: x["a"]).alias("ctx"), F.transform("v", lambda x: x["k"]).alias("n"))
    return lists.mapInPandas(assign, f"{key} {kind}, c long, z int, ctx array<int>, n array<long>")


class ClassModel:
    """Class bigrams and word counts by class; ``words`` is the table (word, c, z) of the words that are not held."""

    def __init__(self, lexicon: Lexicon, of: np.ndarray, held_class: np.ndarray, moves: np.ndarray, kinds: np.ndarray, discount: float, words: DataFrame) -> None:
        self.lexicon, self.of, self.held_class, self.discount, self.words = lexicon, of, held_class, discount, words
        size = moves.sum(0)
        share = size / size.sum() if size.sum() else np.r_[np.zeros(len(size) - 1), 1.0]
        self.step = (moves + SMOOTHING * share) / (moves.sum(1, keepdims=True) + SMOOTHING)
        with np.errstate(divide="ignore", invalid="ignore"):
            unknown = np.where(size > 0, discount * kinds / size, 0.0)
            unknown[-1] = 0  # the end is always known
            follows = self.step @ unknown
            self.unknown = np.log10(np.where(follows > 0, follows, 1.0 / (lexicon.n + lexicon.v + 1)))
            self.cell = np.log10(self.step) - np.log10(np.maximum(size, 1))  # of a word counted so often, before its own count
            self.cell[:, -1] = np.log10(self.step[:, -1])
            word = np.log10(np.maximum(lexicon.counts - discount, 1e-9))
            word[-1] = 0.0
        self.word = word  # what a held word's own count adds to its class's cell


def _model(seen: DataFrame, lexicon: Lexicon, of: np.ndarray, bigrams: np.ndarray, discount: float) -> ClassModel:
    """The model of the ``occurrences`` of the texts it learns from."""
    classes = int(of[-1])
    onto = np.zeros((len(of), classes + 1))
    onto[np.arange(len(of)), of] = 1
    moves = onto.T @ bigrams @ onto  # all words in the classes of their symbols
    held = F.lit(lexicon.held)
    codes = seen.where("code is not null").groupBy("code").agg(F.sum("k").alias("k"))
    by_number = codes.groupBy((F.col("code") % held).alias("number")).agg(F.collect_list(F.struct(F.floor(F.col("code") / held).cast("int").alias("a"), "k")).alias("v"))
    others = seen.where("word is not null and learns").groupBy("word", "a").agg(F.sum("k").alias("k")).groupBy("word").agg(F.collect_list(F.struct("a", "k")).alias("v"))
    numbered = materialise(_assigned(by_number, "number", lexicon, of, moves, classes))
    words = materialise(_assigned(others, "word", lexicon, of, moves, classes))
    held_class = of[lexicon.symbol].copy()
    for r in numbered.select("number", "z").toLocalIterator():
        held_class[r.number] = r.z
    after, kinds = np.zeros((classes + 1, classes + 1)), np.zeros(classes + 1)
    for frame in (numbered, words):  # at most as many rows as there are pairs of classes
        pairs = frame.select("z", F.explode(F.arrays_zip("ctx", "n")).alias("p")).groupBy("z", F.col("p.ctx").alias("a")).agg(F.sum("p.n").alias("n"))
        for r in pairs.collect():
            after[r.a, r.z] += r.n
        for r in frame.groupBy("z").count().collect():
            kinds[r.z] += r["count"]
    return ClassModel(lexicon, of, held_class, after, kinds, discount, words)


def _lexicon(texts: DataFrame, clustered: int, classes: int, held_words: int) -> tuple[Lexicon, np.ndarray, np.ndarray, float]:
    """Held words, classes of symbols, symbol bigrams and discount of the column ``text``."""
    vocab = materialise(count_words(texts))
    n, v, ones, twos = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    held = frequent_words(vocab, held_words)
    ends = vocab.where(F.col("word") == END).select("c").collect()
    release(vocab)
    lexicon = Lexicon(held, min(clustered, len(held)), ends[0].c if ends else 0, n, v)
    bigrams = _bigrams(texts, lexicon)
    of = exchange(bigrams, lexicon.symbols - 1, min(classes, lexicon.symbols - 1))
    return lexicon, of, bigrams, min(0.95, max(0.3, (ones or 0) / max(1, (ones or 0) + 2 * (twos or 0))))


def _scored(seen: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of ``occurrences``."""
    lexicon = model.lexicon
    shared = seen.sparkSession.sparkContext.broadcast((model.cell, model.held_class.astype(np.int16), model.word))

    @F.pandas_udf("double")
    def local(codes: pd.Series) -> pd.Series:
        cell, held_class, word = shared.value
        lists = codes.tolist()
        out = np.zeros(len(lists))
        for lo in range(0, len(lists), 512):
            part = lists[lo : lo + 512]
            sizes = np.array([len(x) for x in part])  # a text has its end at least
            before, number = np.divmod(np.concatenate(part), len(word))
            out[lo : lo + 512] = np.add.reduceat(cell[before, held_class[number]] + word[number], np.cumsum(sizes) - sizes)
        return pd.Series(out)

    own = seen.where("codes is not null").select("row", "doc_id", "n_tokens", "n_known", "base", local("codes").alias("score"))
    cells = [(a, z, float(model.cell[a, z])) for a in range(len(model.cell)) for z in range(model.cell.shape[1]) if np.isfinite(model.cell[a, z])]
    cells += [(a, -1, float(x)) for a, x in enumerate(model.unknown)]
    cells = F.broadcast(seen.sparkSession.createDataFrame(cells, "a int, z int, cell double"))  # the square of the classes
    tail = seen.where("word is not null").select("row", "word", "a", "k").join(model.words.select("word", "c", "z"), "word", "left").withColumn("z", F.coalesce("z", F.lit(-1)))
    n = F.lit(float(lexicon.n + lexicon.v + 1))
    known = F.col("c").isNotNull()
    tail = tail.join(cells, ["a", "z"]).select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(known, F.col("k")).otherwise(0).alias("n_known"),
        (F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 1) / n)).alias("base"),
        (F.col("k") * (F.col("cell") + F.when(known, F.log10(F.col("c") - model.discount)).otherwise(0.0))).alias("score"),
    )
    found = own.unionByName(tail).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return found.select("doc_id", fold_is(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(int(lexicon.n)).cast("long").alias("train_tokens"), "base_score", "score")


def train(texts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, held_words: int = HELD) -> ClassModel:
    """The model of all rows of ``text``."""
    lexicon, of, bigrams, discount = _lexicon(texts, clustered, classes, held_words)
    seen = materialise(occurrences(texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), lexicon, of, F.lit(True)))
    return _model(seen, lexicon, of, bigrams, discount)


def score_documents(docs: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    A null or empty text is its end alone.  Repeated rows are each scored.  Without training texts every token
    is unknown.
    """
    return _scored(materialise(occurrences(docs, model.lexicon, model.of, F.lit(False))), model)


def train_and_score(docs: DataFrame, learns: Column, clustered: int = CLUSTERED, classes: int = CLASSES, held_words: int = HELD) -> DataFrame:
    """``score_documents`` with the model of the rows for which ``learns`` holds, in one pass less."""
    lexicon, of, bigrams, discount = _lexicon(docs.where(learns), clustered, classes, held_words)
    seen = materialise(occurrences(docs, lexicon, of, learns))
    return _scored(seen, _model(seen, lexicon, of, bigrams, discount))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return train_and_score(docs, F.col("doc_id").isNotNull() & ~fold_is(F.col("doc_id"), 7, 2))
