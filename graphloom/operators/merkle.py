"""Delta sync over a Merkle tree: ranges of hashed ids, whose hashes two sides compare from the root down.

A leaf is a range of the ids' hashes and has a hash of its rows whatever their order; a node above has a hash of its
children.  Two sides that agree on a node agree on all below it, so they exchange a few hashes for each range that differs,
and rows of those ranges only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sync import row_hash
from graphloom.storage import cut

#: children of a node (bits); rows of a leaf, about; levels at most
BITS, LEAF_ROWS, MOST_LEVELS = 4, 1000, 7


def levels_for(rows: int) -> int:
    """Levels below the root at which leaves have about ``LEAF_ROWS`` rows."""
    return max(1, min(MOST_LEVELS, math.ceil(math.log2(max(rows, 1) / LEAF_ROWS) / BITS) if rows > LEAF_ROWS else 1))


def leaf_of(keys: list[str], levels: int) -> Column:
    """The leaf of a row by the hash of its key: hashed ids lie evenly, and new ids never move others."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS * levels)


def tree(rows: DataFrame, keys: list[str], columns: list[str], levels: int) -> DataFrame:
    """(level, node, hash, n): the root has level 0, the leaves ``levels``; ranges without rows have no node.

    Row hashes are added up in parts, so a range's rows are never brought together, and each level is an aggregation of the
    one below.
    """
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    leaves = rows.select(leaf_of(keys, levels).alias("node"), row_hash(rows, [*keys, *columns]).alias("h"))
    sums = leaves.groupBy("node").agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(4)))
    level = cut(sums.select(F.lit(levels).alias("level"), "node", F.sha2(F.concat_ws(":", "n", *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("hash"), "n"))
    out = level
    for at in range(levels - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most 2^BITS
        level = level.groupBy(F.shiftright("node", BITS).alias("node")).agg(F.sha2(F.concat_ws(",", F.transform(children, lambda c: F.concat_ws("=", c["node"].cast("string"), c["hash"]))), 256).alias("hash"), F.sum("n").alias("n"))
        level = level.select(F.lit(at).alias("level"), "node", "hash", "n")
        out = out.unionByName(level)
    return out


def differing(mine: DataFrame, theirs: DataFrame, levels: int) -> tuple[DataFrame, list[int]]:
    """(leaves that differ, as ``node``; how many nodes were compared at each level).

    Only children of nodes that differ are looked at; those are what one side asks the other for.
    """
    suspects, asked = None, []
    for at in range(levels + 1):
        a, b = (x.where(F.col("level") == at).select("node", F.col("hash").alias(h)) for x, h in ((mine, "ours"), (theirs, "others")))
        if suspects is not None:
            up = suspects.select(F.col("node").alias("up"))
            a, b = (x.join(up, F.shiftright("node", BITS) == F.col("up"), "left_semi") for x in (a, b))
        met = cut(a.join(b, "node", "full_outer"))
        asked.append(met.count())
        suspects = met.where(~F.col("ours").eqNullSafe(F.col("others"))).select("node")
        if not asked[-1]:
            break
    return suspects, asked


def delta(local: DataFrame, remote: DataFrame, keys: list[str], hash_column: str = "content_hash", levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to send, keys to remove, ranges): what makes ``remote`` (keys, hash) like ``local``.

    Both sides bring their trees; rows and keys are compared within the ranges that differ, nothing else is read for it but
    by its range.  Null keys take no part.
    """
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    local, remote = local.where(present), remote.where(present).select(*keys, hash_column)
    levels = levels or levels_for(local.count())
    ranges, _ = differing(tree(local, keys, [hash_column], levels), tree(remote, keys, [hash_column], levels), levels)
    ranges = cut(ranges)
    inside = lambda x: x.withColumn("__leaf", leaf_of(keys, levels)).join(ranges.select(F.col("node").alias("__leaf")), "__leaf", "left_semi").drop("__leaf")
    mine, theirs = inside(local), inside(remote)
    named = lambda x: x.withColumn("__hash", F.coalesce(hash_column, F.lit("")))
    send = named(mine).join(named(theirs).select(*keys, "__hash"), [*keys, "__hash"], "left_anti").drop("__hash")
    return send, theirs.select(*keys).join(mine.select(*keys), keys, "left_anti").distinct(), ranges
