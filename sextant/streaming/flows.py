"""Streams: incremental indexing by micro-batch, session deduplication, statistics of the request log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def micro_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Hand each micro-batch to ``process(rows, batch id)``; ``every`` None processes what is there and stops.

    ``process`` may be called again with the same batch id after a failure, so it must replace what it wrote under that id.
    """
    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)
    return w.start()


def first_per_session(stream: DataFrame, session: str = "session", key: str = "fqn", ts: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Rows whose key wasn't sent in the session before; state is kept for ``horizon`` of event time."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([session, key])


def not_yet_sent(rows: DataFrame, sent: DataFrame, session: str = "session", key: str = "fqn") -> DataFrame:
    """The batch form: rows without those already in the table of what was sent, each once."""
    return rows.join(sent.select(session, key), [session, key], "left_anti").dropDuplicates([session, key])


def tool_statistics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, tool, calls, mean_ms, max_ms by window of event time; rows later than ``late`` are left out of streams. Also for batches."""
    d = log.where(F.col("tool").isNotNull())
    if log.isStreaming:
        d = d.withWatermark("ts", late)
    g = d.groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.avg("elapsed_ms").alias("mean_ms"), F.max("elapsed_ms").alias("max_ms"))
    return g.select(F.col("w.start").alias("start"), "tool", "calls", "mean_ms", "max_ms")
