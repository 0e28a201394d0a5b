import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import brown

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), brown.END]


def rounded(r):
    return tuple((x is None, round(x, 6) if x is not None else 0) for x in r)


@pytest.mark.parametrize("held", [50, 200_000])
def test_base_scores_against_brute_force(spark, held):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9001, ""), (None, "the of The  tail\x1fword"), (9003, "unseenword " * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learnt = docs.where(F.col("doc_id").isNotNull() & ~brown.fold_is(F.col("doc_id"), 7, 2))
    got = brown.score_documents(docs, brown.train(learnt, 40, 6, held)).collect()
    assert sorted(map(rounded, got)) == sorted(map(rounded, brown.train_and_score(docs, F.col("doc_id").isNotNull() & ~brown.fold_is(F.col("doc_id"), 7, 2), 40, 6, held).collect()))
    c = Counter(w for i, t in rows if i is not None and not fold(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, fold(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want


def test_model_beats_the_base_on_held_out_texts(spark):
    got = brown.op10_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


TEXTS = ["a b a b c", "a b d e f g", "b a x. y. zeta beta", "", "zeta a b zeta", "gamma delta a", None]


@pytest.mark.parametrize("held", [3, 5, 200_000])
def test_scores_against_brute_force(spark, held):
    """Counts by dictionaries with the classes that the model found: every text's score, word by word."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = brown.train(docs, 3, 4, held)
    lexicon = model.lexicon
    number = {w.decode(): k for w, k in lexicon.number.items()}
    z = {w: int(model.held_class[k]) for w, k in number.items()} | {r.word: r.z for r in model.words.collect()}
    end = int(model.of[-1])
    z[brown.END] = end

    def before(w):
        if w == brown.END:
            return end
        return int(model.of[number[w]]) if number.get(w, lexicon.core) < lexicon.core else int(model.of[lexicon.core + brown.ending(w.encode())])

    lines = [tokens(t) for t in TEXTS]
    c = Counter(w for line in lines for w in line)
    n, v = sum(c.values()), len(c)
    pair, size, kinds = Counter(), Counter(), Counter()
    for line in lines:
        for x, y in zip([brown.END, *line], line):
            pair[before(x), z[y]] += 1
            size[z[y]] += 1
    for w in c:
        kinds[z[w]] += 1
    d, s = model.discount, brown.SMOOTHING

    def step(a, b):
        return (pair[a, b] + s * size[b] / n) / (sum(k for (x, _), k in pair.items() if x == a) + s)

    def prob(x, y):
        a = before(x)
        if y == brown.END:
            return step(a, end)
        if y in c:
            return step(a, z[y]) * (c[y] - d) / size[z[y]]
        return sum(step(a, b) * d * kinds[b] / size[b] for b in size if b != end)

    asked = [*TEXTS, "a new word", "b a q. zeta", "unseen unseen2 a"]
    got = {r.doc_id: r for r in brown.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(asked):
        line = tokens(text)
        assert abs(got[k].score - sum(math.log10(prob(x, y)) for x, y in zip([brown.END, *line], line))) < 1e-9
        assert got[k].n_tokens == len(line) and got[k].n_known == sum(c[w] > 0 for w in line)
    for x in ("a", "zeta", "new"):  # the next token is some word, the end or an unknown word
        assert abs(sum(prob(x, y) for y in c) + prob(x, "never seen") - 1) < 1e-9


def test_words_go_to_the_best_class():
    rng = np.random.default_rng(5)
    moves = rng.integers(1, 60, (5, 5)).astype(float)
    first = np.array([0, 1, 2, 3, 1])
    contexts, counts = [[0, 2], [1], [3, 4, 0], [2], [0, 1, 2]], [[1, 3], [1], [2, 1, 1], [1], [1, 1, 1]]
    for w in range(5):
        for a, n in zip(contexts[w], counts[w]):
            moves[a, first[w]] += n

    def likelihood(w, b):
        m = moves.copy()
        for a, n in zip(contexts[w], counts[w]):
            m[a, first[w]] -= n
            m[a, b] += n
        return brown._f(m[:, :4]).sum() - brown._f(m[:, :4].sum(0)).sum()

    got = brown.best_classes(first, contexts, counts, moves, 4)
    assert got.tolist() == [int(np.argmax([likelihood(w, b) for b in range(4)])) for w in range(5)]


def test_exchange_finds_planted_classes_and_never_loses_likelihood():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 30)
    step = np.array([[0.8, 0.1, 0.1], [0.1, 0.1, 0.8], [0.1, 0.8, 0.1]])
    bigrams = np.array([[rng.poisson(40 * step[a, b]) for b in truth] for a in truth], float)

    def likelihood(of):
        onto = np.eye(int(of.max()) + 1)[of]
        n = onto.T @ bigrams @ onto
        return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum()

    of = brown.exchange(bigrams, 30, 3)
    assert likelihood(of) >= likelihood(np.arange(30) % 3)
    assert len({(a, b) for a, b in zip(of, truth)}) == 3


def test_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = brown.train(none)
    assert brown.score_documents(none, model).collect() == []
    got = brown.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_a_long_text_scores_like_its_words(spark, monkeypatch):
    texts = ["a b a b c", "a c b", "long " * 60_000 + "tail " + "a b " * 60_000]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, base double")
    model = brown.train(docs, 2, 3, 2)
    got = {r.doc_id: r for r in brown.score_documents(docs, model).collect()}
    assert got[2].n_tokens == 180_002 == got[2].n_known and np.isfinite(got[2].score)
