"""Stored adjacency: the edges in two copies, bucketed and sorted by either end, so that a step of a search moves only its frontier.

A node with very many edges would make its bucket a single large task.  The edges of such hubs, of which there are at most
``MOST_HUBS`` a direction, are stored apart without buckets; the part of a frontier that lies on hubs is sent to them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut, release

#: edges in a bucket, about, and buckets at most
BUCKET_EDGES, MOST_BUCKETS = 2_000_000, 20_000
#: an end with more than a ten-thousandth of all edges, and more than this, is a hub: at most ten thousand are
HUB_EDGES, MOST_HUBS = 100_000, 10_000
SENT_FRONTIER = 200_000
COLUMNS = ("label", "from_id", "to_id", "call_site")


@dataclass
class Adjacency:
    """Where the copies are: a bucketed table and a folder of hub edges for each end."""

    spark: SparkSession
    path: str
    buckets: int
    tables: dict[str, str]

    def _side(self, end: str, labels: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Steps (src, dst, label, call_site) out of that end: those by bucket, and those of hubs."""
        other = "to_id" if end == "from_id" else "from_id"
        ddl = ", ".join(f"{c} string" for c in COLUMNS)
        for frame in (self.spark.table(self.tables[end]), self.spark.read.schema(ddl).parquet(f"{self.path}/hubs/{end}")):
            if labels:
                frame = frame.where(F.col("label").isin(*labels))
            yield frame.select(F.col(end).alias("src"), F.col(other).alias("dst"), F.col("label").alias("edge_label"), "call_site")

    def step(self, ahead: DataFrame, direction: str = "forward", labels: list[str] | None = None, rows: int | None = None) -> DataFrame:
        """``ahead`` (with ``src``) joined with the steps out of it.

        A frontier of few ``rows`` is sent to the edges, any other is shuffled to their buckets; the edges never move.  The
        nodes of a frontier that are hubs are few for each seed, and go to the hubs' edges by themselves.
        """
        out = None
        for end in {"forward": ["from_id"], "reverse": ["to_id"], "both": ["from_id", "to_id"]}[direction]:
            cold, hot = self._side(end, labels)
            near = F.broadcast(ahead) if rows is not None and rows <= SENT_FRONTIER else ahead.hint("shuffle_merge")
            met = cold.join(near, "src").unionByName(hot.join(near if rows is not None and rows <= SENT_FRONTIER else ahead, "src"))
            out = met if out is None else out.unionByName(met)
        return out

    def drop(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def save(edges: DataFrame, path: str, buckets: int | None = None) -> Adjacency:
    """Stores ``edges`` (label, from_id, to_id and perhaps call_site) below ``path``.

    Null ends lead nowhere and are not stored; repeated edges stay.  The number of buckets comes from the number of edges.
    """
    spark = edges.sparkSession
    site = F.col("call_site") if "call_site" in edges.columns else F.lit(None).cast("string")
    rows = edges.where("from_id is not null and to_id is not null").select("label", "from_id", "to_id", site.cast("string").alias("call_site"))
    rows = cut(rows)  # read for the count, and for the hubs and the others of either end: made once
    total = rows.count()
    buckets = buckets or max(1, min(MOST_BUCKETS, math.ceil(total / BUCKET_EDGES)), min(total // 10_000, spark.sparkContext.defaultParallelism))
    tables = {}
    for end in ("from_id", "to_id"):
        hubs = rows.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > max(HUB_EDGES, total // MOST_HUBS)).select(end)
        hubs = F.broadcast(hubs)
        rows.join(hubs, end, "left_semi").select(*COLUMNS).write.parquet(f"{path}/hubs/{end}")
        name = tables[end] = f"adjacency_{end}_{uuid.uuid4().hex[:12]}"
        cold = rows.join(hubs, end, "left_anti").select(*COLUMNS)
        # dealt like the buckets first, so each task writes one file
        cold.repartition(buckets, end).write.bucketBy(buckets, end).sortBy(end).option("path", f"{path}/by_{end}").saveAsTable(name)
    release(rows)
    spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path}/about")
    return Adjacency(spark, path, buckets, tables)


def load(spark: SparkSession, path: str) -> Adjacency:
    """The adjacency stored at ``path``, in a session whose catalogue does not know it yet."""
    buckets = json.loads(spark.read.text(f"{path}/about").first()[0])["buckets"]
    tables = {}
    for end in ("from_id", "to_id"):
        name = tables[end] = f"adjacency_{end}_{uuid.uuid4().hex[:12]}"
        columns = ", ".join(f"{c} STRING" for c in COLUMNS)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({end}) SORTED BY ({end}) INTO {buckets} BUCKETS LOCATION '{path}/by_{end}'")
    return Adjacency(spark, path, buckets, tables)
