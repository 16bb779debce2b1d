"""File-system events as streams: quiet-period debouncing, one scan in flight for each folder, and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, *, key: str, time: str, quiet: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, first_event, fired_at, events): one row for each run of events that ends with a quiet period.

    Works on batches and on streams; a stream gives a row once the watermark has passed the quiet period.  NULL keys and
    times take no part.
    """
    e = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("at")).where("key is not null and at is not null")
    if events.isStreaming:
        e = e.withWatermark("at", late)
    g = e.groupBy("key", F.session_window("at", quiet).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("key", F.col("w.start").alias("first_event"), F.col("w.end").alias("fired_at"), "events")


STATE = "in_flight boolean, pending boolean"
REQUEST = "key string, at timestamp, reason string"


def _coalesce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    in_flight, pending = state.get if state.exists else (False, False)
    out = []
    rows = pd.concat(list(batches)).sort_values(["at", "kind"])
    for at, kind in zip(rows["at"], rows["kind"], strict=True):
        if kind == "fire":
            if in_flight:
                pending = True
            else:
                in_flight = True
                out.append((key[0], at, "quiet"))
        elif kind in ("completed", "failed", "cancelled") and in_flight:
            in_flight = pending
            if pending:
                out.append((key[0], at, "deferred"))
            pending = False
    state.update((in_flight, pending))
    yield pd.DataFrame(out, columns=["key", "at", "reason"])


def one_in_flight(signals: DataFrame) -> DataFrame:
    """Scan requests from `signals(key, at, kind)`: at most one scan of a key at a time, any number of firings meanwhile give exactly one
    deferred scan when it ends (T3).  Kinds: fire, completed, failed, cancelled."""
    s = signals.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), "kind").where("key is not null and at is not null")
    return s.groupBy("key").applyInPandasWithState(_coalesce, REQUEST, STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, apply, checkpoint: str, *, once: bool = True, every: str = "5 minutes"):
    """Starts the ingest: `apply(batch, batch_id)` merges each micro-batch; merging is idempotent by key, so a repeated batch does no harm."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
