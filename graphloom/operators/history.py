"""The graph as of any commit: nodes and edges as intervals of validity, and range joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: bits of time that one step of the cells of an interval spans; see ``cells``
STEP, STEPS = 4, 12


def numbered(commits: DataFrame) -> DataFrame:
    """(hash, ts, seq): commits in order of time, ties by hash, numbered from 1 without a single sorted partition.

    Times are told apart by day first: a day's commits are numbered by themselves and the days' sizes, a few rows, added up.
    """
    day = F.date_trunc("day", "ts")
    rows = commits.select("hash", "ts").distinct().withColumn("day", day)
    sizes = rows.groupBy("day").agg(F.count("*").alias("n"))
    before = sizes.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("day").orderBy("ts", "hash"))
    return rows.withColumn("place", place).join(F.broadcast(before), "day").select("hash", "ts", (F.col("before") + F.col("place")).alias("seq"))


def intervals(versions: DataFrame, keys: list[str], values: list[str] = ()) -> DataFrame:
    """(keys, values, introduced, removed): when each version of a node or an edge was valid.

    ``versions`` has the keys, ``seq`` (the commit's number), ``status`` (``deleted``, or anything else for present) and the
    values.  A version holds from its commit up to the next one of its key that deletes it or changes a value; ``removed`` is
    null where it still holds.  Of several versions of a key in one commit the last by values counts, deletions first.
    Versions without a key or a commit take no part.
    """
    known = F.col("seq").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    gone = F.col("status") == "deleted"
    last = versions.where(known).groupBy(*keys, "seq").agg(F.max(F.struct((~F.coalesce(gone, F.lit(False))).alias("present"), *values)).alias("v"))
    w = W.partitionBy(*keys).orderBy("seq")
    before = F.lag("v").over(w)
    changed = last.withColumn("before", before).where(F.col("before").isNull() | ~F.col("v").eqNullSafe(F.col("before")))
    spans = changed.withColumn("removed", F.lead("seq").over(w)).where("v.present")
    return spans.select(*keys, *(F.col(f"v.{c}").alias(c) for c in values), F.col("seq").alias("introduced"), "removed")


def as_of(spans: DataFrame, seq: int) -> DataFrame:
    """What was valid at one commit: a filter that reaches the scan."""
    return spans.where((F.col("introduced") <= seq) & (F.col("removed").isNull() | (F.col("removed") > seq))).drop("introduced", "removed")


def cells(lo: Column, hi: Column) -> Column:
    """A cover of [lo, hi] by few cells (size in bits, number): the largest aligned ones of sizes 2^0, 2^STEP, ... that fit.

    A point lies in exactly one cell of the cover, and its own cells are one a size: an equi join finds every interval that
    holds a point, however long the intervals are, with at most 2 x 2^STEP cells of a size each.
    """
    parts = []
    for k in range(STEPS):
        size, up = STEP * k, STEP * (k + 1)
        at = lambda x: F.shiftright(x, size)  # noqa: E731, B023
        # the part of [lo, hi] in cells of this size that no larger aligned cell within it covers
        first_up, last_up = F.shiftright(lo + F.lit((1 << up) - 1), up), F.shiftright(hi + 1, up)
        inside = first_up < last_up
        low, high = F.shiftright(lo + F.lit((1 << size) - 1), size), F.shiftright(hi + 1, size) - 1
        cut_low, cut_high = F.shiftleft(first_up, STEP) - 1, F.shiftleft(last_up, STEP)
        run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        found = run(low, high)
        if k < STEPS - 1:
            found = F.when(inside, F.concat(run(low, cut_low), run(cut_high, high))).otherwise(found)
        parts.append(F.transform(found, lambda n: F.struct(F.lit(size).alias("size"), n.alias("cell"))))  # noqa: B023
    return F.flatten(F.array(*parts))


def at_commits(spans: DataFrame, commits: DataFrame) -> DataFrame:
    """``spans`` valid at each of ``commits`` (seq): (seq, ...).  A range join by equal cells.

    Intervals that still hold end at the last of ``commits``.
    """
    last = commits.agg(F.max("seq").cast("long").alias("last"))  # one row
    ended = spans.join(F.broadcast(last)).withColumn("hi", F.least(F.coalesce(F.col("removed") - 1, F.col("last")), F.col("last")).cast("long")).withColumn("lo", F.col("introduced").cast("long")).where("lo <= hi")
    spread = ended.withColumn("c", F.explode(cells(F.col("lo"), F.col("hi")))).select("*", "c.size", "c.cell").drop("c", "last", "lo", "hi")
    points = commits.select(F.col("seq").cast("long").alias("seq")).distinct()
    sizes = F.explode(F.array(*(F.struct(F.lit(STEP * k).alias("size"), F.shiftright("seq", STEP * k).alias("cell")) for k in range(STEPS))))
    return spread.join(points.select("seq", sizes.alias("p")).select("seq", "p.size", "p.cell"), ["size", "cell"]).drop("size", "cell")
