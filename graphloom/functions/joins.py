"""Joins that keep hot keys apart, and exchanges that have more parts for more rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more rows than this and than a ten-thousandth of all rows is joined by itself: at most ``HOT_KEYS`` are
HOT_ROWS, HOT_KEYS = 1_000, 10_000

#: rows that a task of ``dealt`` gets, about
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as its ``rows`` need; as it is where the session's number of parts is enough.

    What is grouped or joined by the keys next takes these parts: a task's share stays the same however large the tables are.
    """
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(rows: DataFrame, keyed: DataFrame, keys: list[str], members: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``keyed``, which has one row a key and in ``members`` how many of ``rows`` have it.

    Hot keys are sent to the rows, so no task gets all rows of one; the others are shuffled.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(members) > bound).drop(members))
    cold = keyed.where(F.col(members) <= bound).drop(members)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))
