import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import sql, topk


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok}):
        if q % every == 0:
            a = min(v for i, v in ok if i == q)
            met = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(met)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def test_against_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 500)]  # many copies of one vector
    rows += [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, rows[0][1])]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, block=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [-1.0, 0.5]), (2, [3.0, 3.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())) == brute(rows)
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 3.0, 1e6]), (1, [1e6, 1.0, -1e6]), (2, [1e6, 1.0, 1e6]), (3, [2e6, 1e6, 7.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())) == brute(rows)


def test_products_beyond_floating_point(spark):
    big = [[100_000_001.0 / 256] * 5, [100_000_003.0 / 256] * 5, [-100_000_007.0 / 256] * 4 + [3e6 / 256], [2e9 / 256, -2e9 / 256, 1.0, 0.0, 1.0 / 256]]
    docs = spark.createDataFrame([(50 * i, v, 0) for i, v in enumerate(big)], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.top_k(docs, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute([(50 * i, v) for i, v in enumerate(big)])
    assert (0, 1, 50, 50000002000000015) in got


def test_repeated_ids_and_a_very_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 120, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(240)]
    rows += [(i, [2.0, 2.0, -1.0, 0.5]) for i in range(0, 700)] + [(50, [2.0, 2.0, -1.0, 0.5])] * 9
    want = brute(rows)
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, block=4).collect())) == want
    con = duckdb.connect()
    con.register("embeddings", frame(spark, rows).select("vec_id", "embedding").toArrow())
    assert sorted(con.sql(sql.EXACT_TOPK).fetchall()) == want


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.sql(sql.EXACT_TOPK).fetchall()) == sorted(tuple(r) for r in topk.op2_exact_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.0]), (1, [1e30, 1.0]), (2, [1.0, 1.0])], [(0, [1.0, 0.0]), (1, [1e17, 1.0])], [(0, [1.0, 0.0]), (1, [-1e18, 1.0])],
    # each half has a place in 64 bits, the sum has not
    [(0, [2.0**27, 2.0**27]), (1, [2.0**19, 2.0**19])],
])
def test_what_64_bits_cannot_hold_is_an_error(spark, rows):
    with pytest.raises(Exception, match="64 bits|too large|OverflowError"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()


def test_sums_at_the_edge_of_64_bits():
    top = np.array([2**62, -(2**62), 5], np.int64)
    assert topk._added(top, np.array([2**62 - 1, -(2**62), 6], np.int64)).tolist() == [2**63 - 1, -(2**63), 11]
    with pytest.raises(OverflowError):
        topk._added(top, top)
