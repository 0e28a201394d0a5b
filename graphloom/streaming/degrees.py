"""Degrees kept up to date: changes of edges become changes of degrees, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import file_system

DDL = "node_id string, called long, calls long"
#: batches after which their changes are folded into the base
FOLD_EVERY = 50


def degree_changes(changes: DataFrame, label: str = "calls") -> DataFrame:
    """(node_id, called, calls): what added (op ``put``) and removed (``delete``) edges change; ends that are null change nothing."""
    sign = F.when(F.col("op") == "put", 1).when(F.col("op") == "delete", -1)
    ends = changes.where((F.col("label") == label) & sign.isNotNull()).select(
        F.explode(F.array(F.struct(F.col("to_id").alias("node_id"), sign.alias("called"), F.lit(0).alias("calls")), F.struct(F.col("from_id").alias("node_id"), F.lit(0).alias("called"), sign.alias("calls")))).alias("e")
    )
    return _summed(ends.select("e.*").where("node_id is not null"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node_id").agg(F.sum("called").alias("called"), F.sum("calls").alias("calls"))


class LiveDegrees:
    """Degrees below a folder: a base, and the changes of the batches after it.

    A batch writes only what it changes, in a folder of its own number: run again after a failure, it writes the same there
    again.  A fold writes base and changes up to a batch into a new base; folders that a base covers are ignored, and
    removed at the next fold, so readers of the one before go on.
    """

    def __init__(self, spark: SparkSession, path: str, label: str = "calls") -> None:
        self.spark, self.path, self.label = spark, path.rstrip("/"), label

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.startswith(f"{kind}-") and fs.exists(file_system(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n.rsplit("-", 1)[1]) for n in done)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in the changes (op, label, from_id, to_id) of batch ``number``; a sink for ``foreachBatch``."""
        bases = self._numbers("base")
        if bases and number <= bases[-1]:
            return  # in the base already
        degree_changes(batch, self.label).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if number - (bases[-1] if bases else -1) >= FOLD_EVERY:
            self.fold(number)

    def _rows(self, upto: int | None = None) -> DataFrame:
        bases = self._numbers("base")
        base = bases[-1] if bases else -1
        parts = [f"{self.path}/base-{base}"] if bases else []
        parts += [f"{self.path}/batch-{n}" for n in self._numbers("batch") if n > base and (upto is None or n <= upto)]
        return self.spark.read.schema(DDL).parquet(*parts) if parts else self.spark.createDataFrame([], DDL)

    def fold(self, number: int) -> None:
        old = self._numbers("base")
        _summed(self._rows(number)).where("called <> 0 or calls <> 0").write.mode("overwrite").parquet(f"{self.path}/base-{number}")
        before = old[-1] if old else -1
        for kind in ("base", "batch"):
            for n in self._numbers(kind):
                if n < before or kind == "batch" and n <= before:
                    fs, at = file_system(self.spark, f"{self.path}/{kind}-{n}")
                    fs.delete(at, True)

    def current(self) -> DataFrame:
        """node_id, call_count, callee_count and centrality of every node with an edge."""
        rows = _summed(self._rows()).where("called <> 0 or calls <> 0")
        return rows.select("node_id", F.col("called").alias("call_count"), F.col("calls").alias("callee_count"), (F.col("called") + F.col("calls")).alias("centrality"))
