import random

import numpy as np
import pytest

from graphloom.llm import pieces as pc


@pytest.fixture(scope="module")
def model():
    return pc.pieces(pc.default_model())


def texts():
    rng = random.Random(4)
    word = lambda a, n: "".join(rng.choices(a, k=n))
    out = ["", " ", "a", "     x", "word " * 60, "a" * 300, " " * 90 + "end", "\n\n\t tab  two   three", "ééé漢字仮名交じり文 🙂🙂 <0x41> </s> ▁▁"]
    for _ in range(30):
        out.append(" ".join(word("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 12)) for _ in range(60)))
        out.append(word("abehilnoprst", 250))
        out.append(word("ab ▁\né漢 in the on er", 200))
    return out


def test_own_merges_equal_the_library(model):
    for t in texts():
        if t:
            assert model.ids(model.merge(("▁" + t).replace(" ", "▁"))) == model.sp.encode(t)


@pytest.mark.parametrize("size", [33, 64, 100])
def test_scan_equals_encoding_whole(model, size):
    for t in texts():
        if t:
            assert pc.encode_in_chunks(model, t, size) == model.sp.encode(t), t


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    m = [np.where(rng.random((3, 3)) < 0.5, rng.integers(-5, 5, (3, 3)), -np.inf) for _ in range(7)]
    want, got = m[0], pc.scan(m)
    for k in range(7):
        want = want if k == 0 else pc.product(want, m[k])
        assert np.array_equal(want, got[k])


def test_documents_round_trip(spark, model):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(500, None, "x"), (500, None, "x"), (None, "again " * 40, "y"), (None, "again " * 40, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = pc.encode_documents(docs, chunk=64)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "round_trip"]
    out = pc.decode_documents(got).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text is None:
            assert r.token_ids is None and r.round_trip is None and r.decoded is None
        else:
            assert list(r.token_ids) == model.sp.encode(r.text) and r.n_tokens == len(r.token_ids)
            assert r.round_trip == (model.sp.decode(list(r.token_ids)) == r.text) and r.decoded == model.sp.decode(list(r.token_ids))
    assert pc.encode_documents(docs.where("false")).collect() == []


def test_whole_table_round_trips(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pc.encode_documents(docs, chunk=2000).select("doc_id", "token_ids", "round_trip").collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip for r in got) and {r.doc_id: list(r.token_ids) for r in got} == {
        k: pc.pieces(pc.default_model()).sp.encode(t) for k, t in want.items()
    }
