"""Overlap of line ranges by a sweep over short slices of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: lines of a slice
SLICE = 1024


def overlapping(nodes: DataFrame, ranges: DataFrame, slice_lines: int = SLICE) -> DataFrame:
    """``nodes`` whose lines meet one of ``ranges`` (file_path, start, end) of their file, each once and with all columns.

    A node meets a range if the greatest end of the ranges that start before the node's end reaches the node's start.  So
    nodes and ranges go once, in the order of the line, through a running maximum: work is the sum of both, not their
    product.  A file is cut into slices, with the maximum of the slices before carried in, so a file with very many nodes and
    ranges is many short groups.  A node without an end ends where it starts; one without lines, and a range without lines,
    always match.  Nodes without a path match nothing.
    """
    start, end = F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0))
    end = F.when(end == 0, start).otherwise(end)
    rows = nodes.where("file_path is not null").select(F.struct(*nodes.columns).alias("row"), F.col("file_path").alias("path"), start.cast("long").alias("lo"), end.cast("long").alias("hi"))
    wide = ranges.where("file_path is not null").select(F.col("file_path").alias("path"), F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"))
    files = wide.groupBy("path").agg(F.max((F.col("lo").isNull() | F.col("hi").isNull()).cast("int")).alias("whole"))
    rows = rows.join(files, "path")
    at_once = rows.where("whole = 1 or (lo = 0 and hi = 0)").select("row.*")

    # one row a file, line and slice: the greatest end of the ranges that start there
    lines = wide.where("lo is not null and hi is not null").groupBy("path", "lo").agg(F.max("hi").alias("hi"))
    lines = lines.withColumn("slice", F.expr(f"lo div {slice_lines}"))
    swept = rows.where("whole = 0 and not (lo = 0 and hi = 0)").withColumn("slice", F.expr(f"hi div {slice_lines}"))
    tops = lines.groupBy("path", "slice").agg(F.max("hi").alias("top")).unionByName(swept.select("path", "slice", F.lit(None).cast("long").alias("top")).distinct())
    tops = tops.groupBy("path", "slice").agg(F.max("top").alias("top"))
    carried = tops.select("path", "slice", F.max("top").over(W.partitionBy("path").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))

    none = F.lit(None).cast(rows.schema["row"].dataType)
    events = swept.select("path", "slice", F.col("hi").alias("line"), F.lit(1).alias("kind"), F.col("lo").alias("from"), F.lit(None).cast("long").alias("reach"), "row").unionByName(
        lines.select("path", "slice", F.col("lo").alias("line"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("from"), F.col("hi").alias("reach"), none.alias("row"))
    )
    # ranges come before nodes of their line
    running = F.max("reach").over(W.partitionBy("path", "slice").orderBy("line", "kind").rowsBetween(W.unboundedPreceding, 0))
    met = events.withColumn("running", running).where("kind = 1").join(carried, ["path", "slice"])
    return at_once.unionByName(met.where(F.greatest("running", "carried") >= F.col("from")).select("row.*"))
