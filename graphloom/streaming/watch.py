"""Streams: windowed event counts with late data, running sequential tests, and dirty files of a watched tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows of ``ts``; rows later than the watermark are dropped in a stream.
    A stream's watermark needs a time with a zone, so there a time without one is read in the session's."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_test(turns: DataFrame, accept: float, reject: float) -> DataFrame:
    """A stream (candidate, turn, llr) to (candidate, decision, turn): the sum of llr is kept for each candidate until it leaves (reject, accept)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, done = state.get if state.exists else (0.0, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("turn")
        for llr in rows["llr"]:
            if done:
                break
            total, n = total + float(llr), n + 1
            if total >= accept or total <= reject:
                done = True
                out.append((key[0], "accept" if total >= accept else "reject", n))
        state.update((total, n, done))
        yield pd.DataFrame(out, columns=["candidate", "decision", "turn"])

    return turns.groupBy("candidate").applyInPandasWithState(step, "candidate long, decision string, turn long", "total double, n long, done boolean", "append", GroupStateTimeout.NoTimeout)


def watch_files(stream: DataFrame, changed: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``changed`` with each micro-batch of new file versions (path, content), one row for each path, newest first."""
    def batch(df: DataFrame, epoch: int) -> None:
        changed(df.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content")), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
