import hashlib
import re
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, sql

DOCS, LABELS = "doc_id long, text string, lang string, source string, digest string, mask int, n long", "doc_id long, quality int, toxic int"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return dict(words=len(words), distinct=len(set(words)), capitals=len(re.findall("[A-Z]", text)), points=len(text), symbols=len(re.findall(r"[#$%&*|]", text)))


def scan(texts, piece=filter_audit.PIECE, kind=None):
    data, bounds = filter_audit.text_buffer(pa.array(texts, kind or pa.string()))
    got = filter_audit.Scanner(data, piece).counts(bounds)
    return [{k: int(v[i]) for k, v in got.items()} for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab A#\t\n\x0b\x1f\x00é 漢😀", max_size=40)), max_size=8), st.integers(1, 60))
def test_scanning_equals_regular_expressions(texts, piece):
    assert scan(texts, piece) == [by_hand(t or "") for t in texts]


def test_long_texts_and_long_words_in_pieces():
    rng = np.random.default_rng(5)
    words = ["w%d" % k for k in rng.integers(0, 3000, 30_000)] + ["x" * 70 + c for c in "aabbc"] + ["é" * 5000, "é" * 5000 + "z"]
    texts = ["", " ".join(words), "one Two", "Q" * 40_000, " ".join(words[:50]) + "\n"]
    for piece in (1 << 10, 1 << 14, 1 << 22):
        assert scan(texts, piece) == [by_hand(t) for t in texts]
    assert scan(texts, 999, pa.large_string()) == [by_hand(t) for t in texts]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_of_one_hash_are_told_apart(monkeypatch, piece):
    monkeypatch.setattr(filter_audit.Scanner, "hashes", lambda self, raw, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(3))
    texts = ["aa bb aa cc", "dddd dddd", "", "ab " * 30 + "q" * 20 + " zz", "x" * 100 + " " + "x" * 99 + "y"]
    assert scan(texts, piece) == [by_hand(t) for t in texts]


def brute(docs, labels):
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (0, 0))
        marks[i] = (max(good, quality == 1), max(bad, toxic == 1))
    rows = []
    for d in docs:
        c = by_hand(d[1] or "")
        fails = {"A": c["words"] < 200, "B": 100 * c["distinct"] < 50 * c["words"], "C": 100 * c["capitals"] > 2 * c["points"], "D": c["symbols"] > 0}
        fails["E"] = d[0] is not None and any(x[0] is not None and x[0] < d[0] and (x[1] or "") == (d[1] or "") for x in docs)
        rows.append((d[3] or "", {k for k in fails if fails[k]}, *(marks.get(d[0], (0, 0)) if d[0] is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total, seen = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), {}
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                seen["".join(order), i + 1] = (len(left), len(gone), sum(f in r[1] for r in mine) - len(gone) - sum(f in r[1] for r in left), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
        out |= {(part, *k): (*v, total[k[0][k[1] - 1]]) for k, v in seen.items()}
    return out


def test_audit_against_applying_every_order(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (5, long, "en", "a"), (3, long, "de", "b"), (5, long, "en", "a"), (9, long, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (None, long, "en", "a"), (None, "", "en", ""),
        (7, "a " * 300, "en", "b"), (8, "LOUD " * 260, "en", "b"), (11, long + " 5% | more", "en", "a"), (12, long + " 5% | more", "en", ""), (4, "short & SWEET", "en", "c"),
    ]
    docs = [(*d, "clash", 3, 4) for d in docs]
    labels = [(5, 1, 0), (5, 0, 1), (7, 0, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1), (12, 1, None)]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    want = brute(docs, labels)
    assert len(got) == 4 * 600 and got == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "s", "", 0, 0)], DOCS)
    assert filter_audit.audit(one, labels).where("kept = 0 and step = 5").count() == 120


def test_copies_in_many_parts_are_never_one_group(spark):
    """A third of all rows equal: rows of one text and part are added up before they meet those of other parts."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    cells = filter_audit.fail_cells(docs, spark.createDataFrame([], LABELS)).groupBy("mask").agg(F.sum("n").alias("n")).collect()
    assert {r.mask: r.n for r in cells} == {filter_audit.A: 401, filter_audit.A | filter_audit.E: 199}
    texts = filter_audit.scanned(docs).toPandas()
    assert bytes(texts.loc[texts.doc_id == 3, "digest"].iloc[0]) == hashlib.sha256(b"copy").digest()
    assert isinstance(texts, pd.DataFrame) and "bit_count" in sql.FILTER_AUDIT
