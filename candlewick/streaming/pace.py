"""How fast a stream goes: its batches' times and rates as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
    StreamingQueryListener,
)

PACE_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("began", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("rows_per_second", T.DoubleType()),
        T.StructField("late_rows", T.LongType()),
        T.StructField("state_rows", T.LongType()),
    ]
)


class PaceLog(StreamingQueryListener):
    """Keeps a row for each batch of the session's streams and appends them to a folder.

    Rows are held until `flush`, whose write runs in the caller's thread: a listener must not
    wait for Spark jobs.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        seconds = p.batchDuration / 1000
        row = (
            str(p.name or p.id),
            p.batchId,
            p.timestamp,
            seconds,
            p.numInputRows,
            p.numInputRows / seconds if seconds else None,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            sum(s.numRowsTotal for s in p.stateOperators),
        )
        with self._lock:
            self._rows.append(row)

    def take(self) -> list[tuple]:
        """What has come in since the last time, without storing it."""
        with self._lock:
            rows, self._rows = self._rows, []
        return rows

    def flush(self) -> int:
        """Append what has come in; returns how many rows. Call it now and then, and last."""
        rows = self.take()
        if rows:
            self._spark.createDataFrame(rows, PACE_SCHEMA).coalesce(1).write.mode("append").parquet(self._folder)
        return len(rows)

    def read(self) -> DataFrame:
        return self._spark.read.schema(PACE_SCHEMA).parquet(self._folder)
