"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut as materialise
from graphloom.storage import new_folder, release

__all__ = ["ascii_lower", "bounded_labelled", "fold_is", "join_spread", "materialise", "new_folder", "release", "slices", "table", "unused"]

#: a key with more rows than this and than a ten-thousandth of all rows is joined by itself
HOT_ROWS, HOT_KEYS = 1_000, 10_000
#: characters of text that a Python function holds at once, beside one longer text
CHARS_AT_ONCE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], most_rows: int = 512, most_chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``texts`` of at most ``most_rows`` rows and, beyond a run's first text, ``most_chars`` characters."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > start and (k - start >= most_rows or chars + n > most_chars):
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a ``key`` and in ``members`` how many of ``rows`` have it.

    Keys with many rows, at most ``HOT_KEYS`` as each has over a ten-thousandth of the ``total``, are sent to the rows,
    so no task gets all rows of one; the others are shuffled.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(members) > bound).drop(members))
    cold = keyed.where(F.col(members) <= bound).drop(members)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it: for a column that is added and dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_is(doc_id: Column, mod: int, value: int) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``value``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == value, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, train: Column) -> DataFrame:
    """At most ``bound`` labelled training rows (doc_id, text, label), chosen by a hash of doc_id.

    ``train`` is a condition on doc_id.  Rows without id, text or a 0/1 label take no part; of several
    labels for one id the largest counts.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # at most `bound` (id, label) pairs of 12 bytes: safe to broadcast; the rows are read several times, so they are cut
    return materialise(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id"))
