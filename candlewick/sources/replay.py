"""Replay of a bar table in date order at a given rate.

The bars are stored once with their place in date order, in blocks of places. A clock, Spark's
rate source, says how many places are due; each micro-batch reads the blocks it needs and
nothing else. The clock's offsets are in the checkpoint, so a replay that is stopped goes on
where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

AT, BLOCK = "at", "block"
BLOCK_ROWS = 100_000


def store_replay(bars: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> int:
    """Store bars with `at`, their place by date and code from 0, in blocks; returns how many.

    Bars of one date and code are ordered by all their columns. Every task places its own
    range of dates; only one count a task meets in one place.
    """
    order = ["trade_date", "ts_code", *(c for c in bars.columns if c not in ("trade_date", "ts_code"))]
    spark = bars.sparkSession
    raw = f"{folder}/ranges"
    placed = bars.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts within the task, above it stands the task's number.
    own = F.monotonically_increasing_id()
    placed.withColumns({"_task": F.spark_partition_id(), "_own": own}).write.mode("overwrite").parquet(raw)
    ranges = spark.read.parquet(raw)
    counts = ranges.groupBy("_task").agg(F.count("*").alias("n"), F.min("_own").alias("_low"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "_task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low")).alias("_base")
    )
    # One row per task of the shuffle above.
    at = (F.col("_own") + F.col("_base")).cast("long")
    rows = ranges.join(F.broadcast(base), "_task").withColumn(AT, at)
    rows = rows.withColumn(BLOCK, F.floor(F.col(AT) / block_rows).cast("long"))
    (
        rows.drop("_task", "_own", "_base")
        .hint("rebalance", BLOCK)
        .sortWithinPartitions(BLOCK, AT)
        .write.mode("overwrite")
        .partitionBy(BLOCK)
        .parquet(f"{folder}/blocks")
    )
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def due_rows(spark: SparkSession, folder: str, first: int, last: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bars of the given places, both included, from the blocks that hold them."""
    rows = spark.read.parquet(f"{folder}/blocks")
    blocks = F.col(BLOCK).between(first // block_rows, last // block_rows)
    return rows.where(blocks & F.col(AT).between(first, last)).drop(BLOCK)


def start_replay(
    spark: SparkSession,
    folder: str,
    handle: Callable[[DataFrame, int], None],
    progress: str,
    rows_per_second: int | None = None,
    rows_per_batch: int | None = None,
    block_rows: int = BLOCK_ROWS,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Give `handle` the bars that are due, with `at`, batch by batch; past the end it gets
    nothing. Either so many rows a second, or so many a batch whatever the time.

    Without `processing_time` it takes one batch and ends; the next start goes on from the
    checkpoint. With it the stream goes on, past the end too, since the clock does. A batch
    that runs again has the same rows, so a handler that overwrites by batch number gets
    every bar once.
    """
    if (rows_per_second is None) == (rows_per_batch is None):
        raise ValueError("give either rows_per_second or rows_per_batch")
    if rows_per_second is not None:
        clock = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    else:
        clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)

    def process(batch: DataFrame, batch_id: int) -> None:
        due = batch.agg(F.min("value").alias("first"), F.max("value").alias("last")).first()
        if due.first is None:
            return
        rows = due_rows(spark, folder, due["first"], due["last"], block_rows)
        if not rows.isEmpty():
            handle(rows, batch_id)

    pace = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        clock.load()
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", progress)
        .trigger(**pace)
        .start()
    )
