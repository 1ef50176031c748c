"""Sinks of change streams: callback, keyed table, topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.operators.apply import CurrentTable, keyed_messages


def listen(changes: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hand every micro-batch to ``handler(batch, number)``. A batch counts as acknowledged when the handler returns."""
    writer = changes.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_table(changes: DataFrame, table: CurrentTable, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Keep a keyed table up to date; a batch that is run again changes nothing."""
    return listen(changes, lambda batch, n: table.apply(batch, n), checkpoint, once=once)


def to_topic(changes: DataFrame, keys: list[str], path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Write (key, value) messages as files, for a broker's file source to pick up."""
    writer = keyed_messages(changes, keys).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class ProgressMetrics(StreamingQueryListener):
    """Counts and latency of the running queries, as the last progress tells them."""

    def __init__(self) -> None:
        self.rows = 0
        self.last: dict = {}
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        self.last = {"batch": p.batchId, "rows": p.numInputRows, "process_latency_ms": dict(p.durationMs).get("triggerExecution")}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(event.exception)
