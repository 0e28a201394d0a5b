"""A registry with a time to live: keyed state over a stream, entries evicted by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "started bigint, seen bigint, n bigint"


def evicted(stream: DataFrame, key: str, time_column: str, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(key, started, seen, n): entries of a registry that have gone ``ttl_seconds`` or longer without a sign of life.

    Every row of ``stream`` is a sign of life of its ``key``.  The first makes an entry, later ones keep it; one that comes
    after the time to live finds the entry gone and makes a new one.  An entry is evicted when the watermark (the newest
    time less ``delay``) passes its end, whether or not its key is ever seen again; rows later than the watermark are
    dropped by it.  State is one row a live key, in the state store: a lost executor's keys come back from its checkpoint.
    Null keys and null times take no part.
    """
    ttl = ttl_seconds * 1_000_000
    kind = stream.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = []
        entry = list(state.get) if state.exists else None
        if state.hasTimedOut:
            gone.append(entry)
            state.remove()
        else:
            # rows of one key in a batch come in any order; their times are small numbers
            for at in sorted(x for pdf in batches for x in pdf["micros"].tolist()):
                if entry is not None and at - entry[1] >= ttl:
                    gone.append(entry)
                    entry = None
                if entry is None:
                    entry = [at, at, 0]
                entry = [min(entry[0], at), max(entry[1], at), entry[2] + 1]
            if entry is not None:
                state.update(tuple(entry))
                end = (entry[1] + ttl) // 1000
                # a time that the watermark has passed already is due at once
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if gone:
            yield pd.DataFrame({key: [name[0]] * len(gone), "started": [e[0] for e in gone], "seen": [e[1] for e in gone], "n": [e[2] for e in gone]})

    # times go through the state as microseconds since the epoch, like the watermark, whatever the session's time zone
    at = F.col(time_column).cast("timestamp")
    rows = stream.where(F.col(key).isNotNull() & at.isNotNull()).select(key, at.alias(time_column), F.unix_micros(at).alias("micros")).withWatermark(time_column, delay)
    out = rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, started long, seen long, n long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("started").alias("started"), F.timestamp_micros("seen").alias("seen"), "n")
