import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import features, quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return query(spark, SF).where("held_out").join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").toPandas()


def area(score, y):
    order = score.rank()
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, toxicity.op1_toxicity, "toxic")
    assert area(got.score, got.y) > 0.97
    assert (got.predicted == got.y).mean() > 0.9


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, quality.op3_quality_classifier, "quality")
    assert area(got.score, got.y) > 0.9
    assert (got.predicted == got.y).mean() > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_no_labels(spark, module):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    model = module.fit(none)
    docs = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (None, "", 1.0), (2, "x " * 50_000, 2.0)], "doc_id long, text string, score double")
    got = module.score_documents(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert module.score_documents(docs.where("false"), model).collect() == []


def test_trees_and_additive_model_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = toxicity.BoostedTrees.fit(x, y).raw(x)
    assert ((raw > 0) == y).mean() > 0.9
    model = quality.AdditiveModel.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.85


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    fitted = toxicity.Isotonic.fit(raw, y)
    grid = fitted(np.linspace(-3, 3, 50))
    assert (np.diff(grid) >= 0).all()
    assert abs(fitted(np.array([0.0]))[0] - 0.5) < 0.1


def test_obfuscated_and_directed_insults_are_seen():
    row = dict(zip(features.SURFACE + features.TOXIC, features.matrix(["you are such an 1d10t !"], {})[0]))
    assert row["obfuscated"] > 0 and row["directed"] > 0
    assert features.matrix([], {}).shape == (0, len(row))


def test_pipeline_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.trained(spark, SF)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


@pytest.mark.parametrize("module,columns", [(toxicity, True), (quality, False)])
def test_query_scores_are_the_models(spark, module, columns):
    """The query's column against the model applied text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(9001, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int"), allowMissingColumns=True)
    model = module.trained(spark, "/root/testdata/sf0.001")
    got = {r.doc_id: r.score for r in module.score_documents(docs, model).collect()}
    for r in docs.collect():
        one = model.score([r.text])[0] if columns else model.score(features.matrix([r.text], None))[0]
        assert abs(got[r.doc_id] - one) < 1e-12


def test_trees_and_tables_against_walks_by_hand():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(400, 3)), (rng.random(400) < 0.5).astype(float)
    trees = toxicity.BoostedTrees.fit(x, y, trees=5, depth=3)
    for row, raw in zip(x[:50], trees.raw(x[:50])):
        total = trees.base
        for f, cut, leaf in zip(trees.feature, trees.above, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > cut[node] else 1)
            total += trees.rate * leaf[node - len(f)]
        assert abs(total - raw) < 1e-9
    model = quality.AdditiveModel.fit(x, y, cycles=8)
    bin_of = lambda edges, v: sum(v > e for e in edges)
    for row, score in zip(x[:50], model.score(x[:50])):
        raw = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        raw += sum(g[bin_of(model.coarse[a], row[a]), bin_of(model.coarse[b], row[b])] for (a, b), g in model.pairs.items())
        assert abs(1 / (1 + np.exp(-raw)) - score) < 1e-9


def test_directed_insults_of_a_long_hostile_text_take_linear_time():
    text = "you idiot " * 40_000 + "far " * 50 + "idiot"
    words = text.split()
    at = [i for i, w in enumerate(words) if w == "you"]
    want = sum(any(abs(i - k) <= features.REACH for k in at[max(0, i // 2 - 9) : i // 2 + 9]) for i, w in enumerate(words) if w == "idiot")
    began = time.time()
    row = features.matrix([text, "idiot " * 8 + "you", "idiot"], {})
    assert time.time() - began < 5
    directed = len(features.SURFACE) + features.TOXIC.index("directed")
    assert row[:, directed].tolist() == pytest.approx([want / len(words), 6 / 9, 0])


def test_stage_keeps_a_column_of_its_own_name(spark):
    docs = spark.createDataFrame([(1, "a quiet text", 0.5)], "doc_id long, text string, __toxicity double")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
