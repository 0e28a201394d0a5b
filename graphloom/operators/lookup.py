"""Point lookups on stored nodes: files sorted by id, with Bloom filters for what they are not sorted by.

A lookup by id reads the row groups whose range of ids holds it; one by qualified name, by name or by path those whose Bloom
filter does not deny the value.  Everything else of the table stays unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.store import find_by_qualified

#: bytes of a row group
ROW_GROUP = 4 << 20
FILTERED = ("node_id", "qualified", "name")


def save(nodes: DataFrame, path: str, row_group: int = ROW_GROUP, rows_expected: int = 1_000_000) -> None:
    """Stores ``nodes`` sorted by ``node_id`` over files, with a Bloom filter of each lookup column in each row group."""
    writer = nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.option("parquet.block.size", row_group)
    for c in FILTERED:
        if c in nodes.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(rows_expected))
    writer.parquet(path)


def by_id(spark: SparkSession, path: str, node_ids: list[str]) -> DataFrame:
    """Rows of a few ids; a plain comparison with values, which the scan can skip by."""
    return spark.read.parquet(path).where(F.col("node_id").isin(*node_ids))


def by_qualified(spark: SparkSession, path: str, qualified: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("qualified") == qualified)


def find(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """At most one node, as ``find_by_qualified`` chooses it: by qualified name, and only where there is none, and the symbol
    has no dot, by plain name.  Each pass reads the row groups that may hold the value."""
    exact = find_by_qualified(by_qualified(spark, path, symbol), symbol)
    if "." in symbol or not exact.isEmpty():
        return exact
    return find_by_qualified(spark.read.parquet(path).where(F.col("name") == symbol), symbol)
