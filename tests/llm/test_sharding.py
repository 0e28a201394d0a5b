import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import common, sharding


def check(got, docs, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_even_shards_and_few_cuts(spark):
    rng = random.Random(6)
    docs = []
    for g in range(600):
        docs += [(len(docs) + k, f"text {g}") for k in range(rng.choice([1, 1, 1, 2, 3, 8]))]
    docs += [(len(docs) + k, "hot text") for k in range(500)]  # larger than a shard
    docs += [(5000, None), (5001, ""), (None, "ümlaut"), (7, "text 1"), (7, "text 1")]
    rng.shuffle(docs)
    got = sharding.shard_documents(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")).collect()
    check(got, docs)
    where = defaultdict(Counter)
    for r in got:
        where[r.text_crc32][r.shard] += 1
    small = [c for c in where.values() if 1 < sum(c.values()) <= 20]
    assert sum(len(c) > 1 for c in small) <= 0.08 * len(small)
    hot = where[zlib.crc32(b"hot text")]
    assert sum(hot.values()) == 500 and len(hot) <= 12  # units are coarse beside so small a quota


def test_tiny_and_empty_tables(spark):
    for n in (0, 1, 3, 17):
        docs = [(k, "same" if k % 2 else None) for k in range(n)]
        check(sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_ranks_are_gapless(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("b"))
    got = sharding._ranked(rows, "g", "b", ["row"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r.place)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_result_does_not_depend_on_files(spark):
    rng = random.Random(8)
    docs = [(k, f"t{rng.randrange(150)}") for k in range(700)] + [(3, "t1")] * 4 + [(None, None)] * 3 + [(k, "hot") for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(sharding.shard_documents(frame.coalesce(1)).collect(), key=str)
    assert one == sorted(sharding.shard_documents(frame.orderBy("text", F.desc("doc_id")).repartition(7)).collect(), key=str)
    check(one, docs)


def test_a_hot_key_of_many_units(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT", 5)
    monkeypatch.setattr(sharding, "BUCKET", 20)
    monkeypatch.setattr(sharding, "TOGETHER", 3)
    docs = [(k, "hot" if k % 3 == 0 else f"t{k // 6}") for k in range(1800)]
    got = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(got, docs)
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot"))
    assert sum(n for _, n in hot.most_common(6)) >= 0.95 * 600  # six shards at least


def test_main_path_has_no_python(spark):
    plan = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_hot_keys_are_joined_by_themselves_with_the_same_rows(spark, monkeypatch):
    """A third of all rows equal, and very long texts: hot keys go another way to the same shards."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").when(F.col("id") % 50 == 1, F.repeat(F.lit("long "), 40_000)).otherwise(F.concat(F.lit("t"), F.col("id") % 350)).alias("text"))
    want = sorted(map(tuple, sharding.shard_documents(docs, 5).collect()))
    monkeypatch.setattr(sharding, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert sorted(map(tuple, sharding.shard_documents(docs, 5).collect())) == want and len(want) == 600
