"""Sharding: balanced label propagation with DataFrame operations only.

Documents that share a link key are linked (the query links equal texts).  A document's first label is a shard by a
hash of itself.  In each round the documents of a key look at how the key's documents lie over the shards and move to
the shard with the most of them, as far as that shard's quota leaves room; demand beyond the room is thinned out by a
hash, so no round needs an order of all documents.  Rounds end when hardly any document would still move.  Then shards
are made even: linked documents beyond a shard's quota and all unlinked documents are fillers, dealt to the room
that is left.  Counts then differ by at most one, and an unlinked filler cuts no link.

A key's documents are never gathered: those of one key and one first label are a unit, or several units of about
``UNIT`` documents, that moves as a whole, so the links are joined by counts.  Positions come from the counts of
buckets of about ``BUCKET`` documents, summed up in two levels.  All choices are hashes of a row's content, so the
result does not depend on how the rows lie in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import HOT_KEYS, HOT_ROWS, join_spread, materialise, release, table

UNIT = 1_000
BUCKET = 1_000
#: buckets whose counts are summed up together
TOGETHER = 1_000
ROUNDS = 12


def _hash_of(columns: list, n: Column | int) -> Column:
    """A hash of the columns as a number from 0 to ``n`` - 1."""
    return F.pmod(F.xxhash64(*columns), n if isinstance(n, Column) else F.lit(n))


def _ranked(rows: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, the position (from 0) in its ``group`` by (bucket, order); ``bucket`` is a number.

    A window runs inside each (group, bucket), of bounded size.  The buckets' counts are summed up in runs of
    ``TOGETHER``, then over the runs: one row in a million or so.
    """
    counts = rows.groupBy(group, bucket).count().withColumn("__run", F.floor(F.col(bucket) / TOGETHER))
    earlier = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy(group, "__run").agg(F.sum("count").alias("count"))
    runs = runs.select(group, "__run", earlier(W.partitionBy(group).orderBy("__run")).alias("__above"))
    inner = counts.withColumn("__in_run", earlier(W.partitionBy(group, "__run").orderBy(bucket)))
    offset = inner.join(runs, [group, "__run"]).select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), (F.col("__above") + F.col("__in_run")).alias("__before"))
    inside = rows.withColumn("__n", F.row_number().over(W.partitionBy(group, bucket).orderBy(*order)) - 1)
    joined = inside.join(offset, (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn("place", F.col("__before") + F.col("__n")).drop("__n", "__g", "__b", "__before")


def _rates(load: list[int], quota: list[int], flow: dict[tuple[int, int], int]) -> list[float]:
    """The share of the documents that want to go to each shard that may: as many as there is room for, counting
    those that leave.  ``flow`` counts wishes by (from, to)."""
    shards = range(len(load))
    rates = [1.0] * len(load)
    for _ in range(30):
        leaving = [sum(n * rates[b] for (a, b), n in flow.items() if a == s) for s in shards]
        wished = [sum(n for (_, b), n in flow.items() if b == s) for s in shards]
        rates = [min(1.0, max(0.0, (quota[s] - load[s] + leaving[s]) / wished[s])) if wished[s] else 1.0 for s in shards]
    return rates


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard, slot) for rows (row, key): ``row`` a distinct long, ``key`` what links rows (null: nothing).

    Shard sizes differ by at most one; slots are gapless from 0 in each shard.  An empty table gives none.
    """
    total = docs.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = docs.where("key is not null").groupBy("key").count()
    members = materialise(sizes.where("count > 1").withColumnRenamed("count", "members"))
    # units: the documents of a key by their first label, large ones in parts
    first = _hash_of(["row"], shards).cast("int")
    parts = F.ceil(F.col("members") / (UNIT * shards))
    linked = materialise(join_spread(docs, members.withColumn("__n", F.col("members")), "key", "__n", total).select("row", "key", "members", first.alias("first"), _hash_of([F.lit(1), "row"], parts).alias("part")))
    units = materialise(linked.groupBy("key", "members", "first", "part").agg(F.count("*").alias("n")).withColumn("shard", F.col("first")))
    # keys that are large beside a shard find their shards first, the others then share out what is left
    large = F.col("members") > max(2, min(quota) // 8)
    state = _propagated(units.where(large), shards, quota, rounds, total)
    left = [q - n for q, n in zip(quota, _loads(state, shards))]
    state = state.unionByName(_propagated(units.where(~large), shards, left, rounds, total))
    buckets = max(1, total // BUCKET)
    # linked documents in the order of their units: a quota's edge cuts one key
    placed = linked.join(state.select("key", "first", "part", "shard"), ["key", "first", "part"])
    # large keys come first: what a shard has no room for is small keys
    home = F.when(large, _hash_of(["key", "first", "part"], buckets)).otherwise(buckets + _hash_of(["key"], buckets))
    placed = _ranked(placed.withColumn("bucket", home), "shard", "bucket", ["key", "first", "part", "row"])
    limit = F.element_at(F.array(*(F.lit(q).cast("long") for q in quota)), F.col("shard") + 1)
    placed = materialise(placed.select("row", "key", "shard", "place", (F.col("place") < limit).alias("stays")))
    stay = placed.where("stays").select("row", "shard", F.col("place").alias("slot"))
    # unlinked rows are those without a key or of a key with one member
    hot = F.col("members") > max(HOT_ROWS, total // HOT_KEYS)  # at most HOT_KEYS keys, which are sent to the rows
    others = docs.join(F.broadcast(members.where(hot).select("key")), "key", "left_anti").join(members.where(~hot).select("key"), "key", "left_anti")
    alone = others.select("row", F.lit(None).cast("string").alias("key"), (buckets + _hash_of(["row"], buckets)).alias("bucket"))
    # what a shard had no room for comes first, key by key, so that it stays together where the room allows
    over = placed.where("not stays").select("row", "key", _hash_of(["key"], buckets).alias("bucket"))
    fillers = alone.unionByName(over).withColumn("all", F.lit(0))
    taken = {r.shard: r.n for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    room, start = [], 0
    for s in range(shards):
        free = quota[s] - taken.get(s, 0)
        room.append((s, start, start + free, taken.get(s, 0)))
        start += free
    rooms = docs.sparkSession.createDataFrame(room, "shard int, lo long, hi long, taken long")
    dealt = _ranked(fillers, "all", "bucket", ["key", "row"]).join(F.broadcast(rooms), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    return stay.unionByName(dealt.select("row", "shard", (F.col("taken") + F.col("place") - F.col("lo")).alias("slot")))


def _loads(state: DataFrame, shards: int) -> list[int]:
    held = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    return [held.get(s, 0) for s in range(shards)]


def _propagated(state: DataFrame, shards: int, quota: list[int], rounds: int, total: int) -> DataFrame:
    """Units after rounds of moves; the rounds end when hardly any document would still move."""
    closed = [s for s in range(shards) if quota[s] <= 0]
    for turn in range(rounds if not state.isEmpty() and len(closed) < shards else 0):
        before, shut = state, closed
        state, closed, moving = _propagate(state, shards, quota, turn, closed)
        if turn:
            release(before)
        if moving <= total // 10_000 and closed == shut or len(closed) == shards:
            break
    return state


def _propagate(state: DataFrame, shards: int, quota: list[int], turn: int, closed: list[int]) -> tuple[DataFrame, list[int], float]:
    """One round over units (key, members, first, part, n, shard): the units after their moves, the shards without room,
    and how many documents moved.  Numbers by shard, or by pair of shards, come to the driver; no others."""
    shares = state.groupBy("key", "members", "shard").agg(F.sum("n").alias("there"))
    # where a key has most of its documents among the shards with room; ties by a hash of key and shard, so that keys spread
    shut = F.col("shard").isin(closed) if closed else F.lit(False)
    free = [s for s in range(shards) if s not in closed]
    some = F.element_at(F.array(*map(F.lit, free)), (_hash_of(["key"], len(free)) + 1).cast("int"))  # for keys with all in shards without room
    best = shares.groupBy("key").agg(F.max(F.when(~shut, F.struct("there", F.xxhash64("key", "shard").alias("tie"), "shard"))).alias("b"))
    best = best.select("key", F.coalesce("b.shard", some).alias("target"), F.coalesce("b.there", F.lit(0)).alias("most"))
    lost = [s for s in closed if quota[s] <= 0]  # nothing may stay there
    leaves = F.col("shard").isin(lost) if lost else F.lit(False)
    better = leaves | (F.col("most") > F.col("there")) | ((F.col("most") == F.col("there")) & (F.xxhash64("key", "target") > F.xxhash64("key", "shard")))
    wishes = materialise(shares.join(best, "key").where((F.col("shard") != F.col("target")) & better).select("key", "shard", "target", "there"))
    flow = {(r.shard, r.target): r.n for r in wishes.groupBy("shard", "target").agg(F.sum("there").alias("n")).collect()}
    loads = _loads(state, shards)
    rates = _rates(loads, quota, flow)
    rate = F.element_at(F.array(*(F.lit(r) for r in rates)), F.col("target") + 1)
    # keys that are small beside a shard go whole, others unit by unit
    whole = F.col("members") <= min(UNIT, max(2, max(quota) // 8))
    chance = F.when(whole, _hash_of(["key", F.lit(turn)], 1 << 30)).otherwise(_hash_of(["key", "first", "part", F.lit(turn)], 1 << 30)) / float(1 << 30)
    goes = F.col("target").isNotNull() & (chance < rate)
    moved = state.join(wishes.select("key", "shard", "target"), ["key", "shard"], "left")
    after = materialise(moved.select("key", "members", "first", "part", "n", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")))
    release(wishes)
    wished = {b: sum(n for (_, t), n in flow.items() if t == b) for b in range(shards)}
    full = [s for s in range(shards) if quota[s] <= 0 or (wished[s] and rates[s] < 0.05) or (s in closed and loads[s] >= 0.95 * quota[s])]
    return after, full, sum(n * rates[b] for (_, b), n in flow.items())


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``rows``.

    Size: UTF-8 bytes of the text and one; a null text counts as none and its crc32 is that of an empty text.
    Equal texts are linked (null ones with each other and with empty ones); repeated rows each get a slot.
    ``grown_shard`` is null under this law.  The rows that come out are the same however the table lies in files.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))
    # repeats are told apart by a number; a row's own number is a hash of its content, or the next free one
    rows = rows.groupBy("doc_id", "size", "text_crc32", "key").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count")))).drop("count")
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "key", "copy"))
    same = rows.groupBy("hash").count().where("count > 1")
    rows = materialise(rows)
    if same.isEmpty():
        rows = rows.withColumn("row", F.col("hash"))
    else:  # hashes that rows share, a handful beyond 10**9 rows: their rows are hashed with another seed
        again = F.xxhash64(F.lit("again"), "doc_id", "key", "copy")
        rows = rows.join(F.broadcast(same.select("hash", F.lit(True).alias("shared"))), "hash", "left").withColumn("row", F.when(F.col("shared"), again).otherwise(F.col("hash")))
    placed = balanced_shards(rows.select("row", "key"), shards)
    return rows.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)
