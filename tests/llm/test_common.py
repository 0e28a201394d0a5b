import pandas as pd
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.llm import common


def test_slices_hold_bounded_rows_and_characters():
    texts = ["a" * 5, None, "b" * 30, "c" * 200, "", "d" * 4] + ["e"] * 9
    runs = list(common.slices(texts, most_rows=4, most_chars=40))
    assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(len(texts)))
    assert all(hi - lo <= 4 and (hi - lo == 1 or sum(len(t or "") for t in texts[lo:hi]) <= 40) for lo, hi in runs)
    assert list(common.slices([])) == []


def test_arrow_batches_are_bounded_in_bytes(spark):
    """The session's own bound: long texts come to Python in batches of about that many bytes."""
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert int(most.rstrip("b")) <= 64 << 20
    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [int(b["text"].str.len().sum())]}) for b in batches), "n long").collect()
    assert len(sizes) > 3 and max(r.n for r in sizes) <= (64 << 20) + (1 << 20)


def test_join_spread_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(200).select((F.col("id") % 20 * F.when(F.col("id") < 100, 0).otherwise(1)).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 3")
    got = common.join_spread(rows, keyed, "k", "n", 200)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed.drop("n"), "k").collect()))


def test_cut_tables_live_in_the_shared_folder_and_can_be_released(spark):
    df = common.materialise(spark.range(5))
    fs, at = storage.file_system(spark, df._cut_path)
    assert df._cut_path.startswith(storage.shared_dir(spark)) and fs.exists(at) and df.count() == 5
    common.release(df, spark.range(2))
    assert not fs.exists(at)
