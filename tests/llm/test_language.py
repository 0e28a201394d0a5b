from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language as lg

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return lg.trained(spark, SF)


def test_held_out_accuracy_and_rejection(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lg.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all() and got.accepted.mean() > 0.99
    assert lg.drop_unidentified(docs, model).columns == docs.columns


def test_odd_texts(spark, model):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "123 !!", 1), (4, "the and of " * 100_000, 1), (5, "漢字仮名" * 50, 1)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.lang_pred, r.accepted) for r in lg.identify(docs, model).collect()}
    assert got >= {(1, "und", False), (None, "und", False), (4, "en", True)}
    assert (5, False) in {(d, a) for d, _, a in got}
    assert lg.identify(docs.where("false"), model).collect() == []


def test_probabilities_sum_to_one(spark, model):
    """For a context, the seen characters and the share left for unseen ones make a distribution."""
    for context in ("  t", "he ", "xq"):
        total = 0
        for c in set(map(chr, np.unique(lg.codes("abcdefghijklmnopqrstuvwxyzäöüßéèêçñóíáúàâîôûœ ")))):
            seq = np.array([ord(x) for x in context + c], np.uint64)
            total = total + np.exp(model.log_probs(seq)[-1].astype(float))
        assert (total < 1.02).all() and (total > 0.9).all()


def test_long_text_in_pieces_scores_like_one_piece(model, monkeypatch):
    text = "thereof, and nothing   but the thing! " * 300 + "  .. "
    texts = [text, "x", "", None, " ", "12" * 3000, text, "a" * 2001]
    whole, chars = model.cross_entropy(texts)
    lines = [lg.codes(t).tolist() for t in texts]
    for size in (1000, 7, 1):
        monkeypatch.setattr(lg, "CHARS_AT_ONCE", size)
        parts, again = model.cross_entropy(texts)
        assert np.allclose(whole, parts, rtol=1e-6) and (chars == again).all()
        assert [lg.codes(t).tolist() for t in texts] == lines


def brute_log_probs(texts, order, letters):
    """Interpolated Kneser-Ney by dictionaries: a function of (history, character)."""
    high, lower = Counter(), [Counter() for _ in range(order)]
    for text in texts:
        line = " " * order + text
        for k in range(order, len(line)):
            high[line[k - order + 1 : k + 1]] += 1
    lower[order - 1] = high
    for n in range(order - 1, 0, -1):
        for gram in lower[n]:
            lower[n - 1][gram[1:]] += 1

    def weight(n, context):
        grams = {g: c for g, c in lower[n - 1].items() if g[:-1] == context}
        ones, twos = (sum(c == k for c in lower[n - 1].values()) for k in (1, 2))
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        return discount, sum(grams.values()), len(grams)

    def prob(context, char):
        n = len(context) + 1
        below = prob(context[1:], char) if context else 1 / letters
        discount, total, kinds = weight(n, context)
        if not total:
            return below
        return max(lower[n - 1][context + char] - discount, 0) / total + discount * kinds / total * below

    return prob


def test_scores_against_brute_force(spark):
    texts = {"aa": ["abra cadabra", "a cab", "drab bard"], "bb": ["foo of fog", "good dog", "goof off fog"]}
    rows = [(k * 10 + i, t, lang) for k, (lang, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    model = lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = ["a fog", "cab", "good bard", "drab dog", "cadabra", "zebra"]
    entropy, chars = model.cross_entropy(asked)
    letters = len({c for ts in texts.values() for t in ts for c in f" {t} "}) + 1
    for k, lang in enumerate(sorted(texts)):
        prob = brute_log_probs([f" {t} " for t in texts[lang]], lg.ORDER, letters)
        for text, got, n in zip(asked, entropy[:, k], chars):
            line = " " * lg.ORDER + f" {text} "
            want = -sum(np.log(prob(line[i - lg.ORDER + 1 : i], line[i])) for i in range(lg.ORDER, len(line))) / n
            assert abs(got - want) < 1e-4 * want
    best = entropy.argmin(1)
    assert model.predict(asked)[0].tolist() == [sorted(texts)[k] for k in best]


def test_sample_is_bounded_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(lg, "TRAINING_ROWS", 7)
    monkeypatch.setattr(lg, "TRAINING_CHARS", 40)
    monkeypatch.setattr(lg, "LANGUAGES", 2)
    rows = [(k, "x" * (1 + k % 9), ["en", "de", "fr"][min(k % 5, 2)]) for k in range(500)] + [(3, "xxxx", "fr")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lg.sample(frame).collect()
    by = Counter(r.lang for r in got)
    assert set(by) == {"fr", "de"} or set(by) == {"fr", "en"}
    assert max(by.values()) <= 7 and all(sum(len(r.text) for r in got if r.lang == x) < 40 + 9 for x in by)
    assert sorted(map(tuple, lg.sample(frame.repartition(5)).collect())) == sorted(map(tuple, got))


def test_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = lg.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), lg.fit(none, lg.F.lit(True))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_a_language_of_few_ids_and_one_of_long_texts_are_learnt(spark, monkeypatch):
    """20,000 rows of one id; texts beyond the longest that is sampled whole; letters of the last planes."""
    monkeypatch.setattr(lg, "LONGEST_SAMPLED", 2000)
    few = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("mata kule " * 20).alias("text"), F.lit("xx").alias("lang"))
    rest = [(100 + k, "the house is of wood and stone " * 10, "en") for k in range(40)] + [(300 + k, "zwölf boxkämpfer jagen " * 400, "de") for k in range(3)]
    docs = few.unionByName(spark.createDataFrame(rest, few.schema))
    chosen = lg.sample(docs).collect()
    assert {r.lang for r in chosen} == {"xx", "en", "de"} and [r.doc_id for r in chosen if r.lang == "xx"] == [7]
    assert max(len(r.text) for r in chosen) == 2000
    model = lg.fit(docs, F.lit(True))
    asked = spark.createDataFrame([(1, "kule mata kule"), (2, "boxkämpfer jagen zwölf"), (3, "\U00031350\U00031351")], "doc_id long, text string")
    assert [r.lang_pred for r in lg.identify(asked, model).orderBy("doc_id").collect()][:2] == ["xx", "de"]
    assert lg.letters()[0x31350] and len(lg.codes("\U00031350")) == 3


def test_stage_keeps_columns_of_any_name(spark, model):
    docs = spark.createDataFrame([(1, "the house and the river of the town", "mine", 5)], "doc_id long, text string, __language string, accepted int")
    assert lg.drop_unidentified(docs, model).collect() == docs.collect()
