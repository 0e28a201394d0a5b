"""Streaming: the change feed, live deltas, windows over events and a registry with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def read_changes(spark: SparkSession, path: str, ddl: str, since=None, time_column: str = "ts", retention: str = "7 days", files_per_trigger: int | None = None) -> DataFrame:
    """An append-only change log as a stream; entries older than ``retention`` behind the newest are late."""
    reader = spark.readStream.schema(ddl)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    changes = reader.parquet(path).withWatermark(time_column, retention)
    return changes if since is None else changes.where(F.col(time_column) >= since)


def latest_by_key(batch: DataFrame, keys: list[str], time_column: str = "ts") -> DataFrame:
    """The last change of each key in a batch."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), time_column).alias("r")).select(*keys, "r.*")


def write_graph(stream: DataFrame, write_nodes: Callable[[DataFrame], None], write_edges: Callable[[DataFrame], None], checkpoint: str, kind: str = "kind") -> StreamingQuery:
    """Each batch of changes (``kind`` node or edge) goes to the sinks, nodes first.

    A batch that is run again after a failure is written again: the node sink replaces by key; the edge sink gets the
    batch number in ``batch_id``, by which ``GraphStore.stream_edges`` replaces what it has of that batch.
    """

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write_nodes(batch.where(F.col(kind) == "node"))
            write_edges(batch.where(F.col(kind) == "edge").withColumn("batch_id", F.lit(number)))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, keys: list[str] = (), time_column: str = "ts", watermark: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of fixed windows; the same plan on a stream and on a table."""
    rows = events.withWatermark(time_column, watermark) if watermark else events
    return rows.groupBy(F.window(time_column, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str] = (), time_column: str = "ts", watermark: str | None = None) -> DataFrame:
    rows = events.withWatermark(time_column, watermark) if watermark else events
    return rows.groupBy(F.window(time_column, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], time_column: str = "ts", watermark: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n): runs of events with less than ``gap`` between them."""
    rows = events.withWatermark(time_column, watermark) if watermark else events
    return rows.groupBy(*keys, F.session_window(time_column, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def live_entries(entries: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Registry entries (key, ts) still alive: the newest of each key, younger than ``minutes``."""
    newest = entries.groupBy("key").agg(F.max("ts").alias("ts"))
    return newest.where(F.col("ts") > F.lit(as_of) - F.make_dt_interval(mins=F.lit(minutes)))


def delta_rows(nodes: DataFrame, edges: DataFrame, op: str = "put") -> DataFrame:
    """Changed nodes and edges as a client sees them: (op, kind, id, label, name, file_path, start_line, from_id, to_id)."""
    none = F.lit(None).cast("string")
    a = nodes.select(F.lit(op).alias("op"), F.lit("node").alias("kind"), F.col("node_id").alias("id"), "label", F.coalesce("qualified", "name").alias("name"), "file_path", F.col("start_line").cast("int").alias("start_line"), none.alias("from_id"), none.alias("to_id"))
    b = edges.select(F.lit(op).alias("op"), F.lit("edge").alias("kind"), F.concat("from_id", F.lit(">"), "label", F.lit(">"), "to_id").alias("id"), "label", none.alias("name"), none.alias("file_path"), F.lit(None).cast("int").alias("start_line"), "from_id", "to_id")
    return a.unionByName(b)


#: what a state may become
MOVES = {"pending": ("running", "skipped"), "running": ("completed", "failed")}


def stage_states(moves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, n_moves, n_refused) of stages whose moves (keys, ts, seq, to) were logged.

    Every stage begins as pending; moves are taken in the order of time and ``seq``, and one that its state does not allow is
    refused and changes nothing.  A stage's log is a handful of rows and is folded as an array.
    """
    step = "case " + " ".join(f"when s.state = '{state}' and x.to in ({', '.join(repr(t) for t in to)}) then named_struct('state', x.to, 'refused', s.refused)" for state, to in MOVES.items())
    fold = f"aggregate(log, named_struct('state', 'pending', 'refused', 0L), (s, x) -> {step} else named_struct('state', s.state, 'refused', s.refused + 1L) end)"
    logs = moves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "to"))).alias("log"))
    return logs.select(*keys, F.size("log").cast("long").alias("n_moves"), F.expr(fold).alias("f")).select(*keys, "f.state", "n_moves", F.col("f.refused").alias("n_refused"))


STAGES = ("pending", "running", "completed", "failed", "skipped")
MOST_ERRORS = 50


class StageTracker:
    """States of the stages of a run on the driver: pending, running, then completed, failed or skipped."""

    def __init__(self, stages: list[str]) -> None:
        self.state = dict.fromkeys(stages, "pending")
        self.errors: dict[str, list[str]] = {s: [] for s in stages}
        self.counts = dict.fromkeys(stages, 0)

    def move(self, stage: str, to: str) -> None:
        if to not in MOVES.get(self.state[stage], ()):
            raise ValueError(f"{stage}: {self.state[stage]} cannot become {to}")
        self.state[stage] = to

    def error(self, stage: str, message: str) -> None:
        if len(self.errors[stage]) < MOST_ERRORS:
            self.errors[stage].append(message)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, self.state[s], self.counts[s], self.errors[s]) for s in self.state], "stage string, state string, n long, errors array<string>")


class ProgressTicks(StreamingQueryListener):
    """Hands each progress report of a query to a callable."""

    def __init__(self, tick: Callable[[dict], None]) -> None:
        self.tick = tick

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tick({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tick({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tick({"event": "terminated", "id": str(event.id), "error": event.exception})
