"""What comes in before any indicator: repeats and rejected messages of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.rows import REQUIRED
from candlewick.sources import messages as M

_TIME = "_event_time"
REJECT_SCHEMA = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())]
)
UNREADABLE = "unreadable"


def dated(trade_date: Column) -> Column:
    """Time of a `yyyyMMdd` date or `yyyyMMddHH` hour; null if it is neither."""
    form = F.when(F.length(trade_date) == 10, F.lit("yyyyMMddHH")).otherwise(F.lit("yyyyMMdd"))
    return F.try_to_timestamp(trade_date, form)


def without_repeats(
    records: DataFrame, delay: str, key: tuple[str, ...] = ("ts_code", "trade_date")
) -> DataFrame:
    """The first record of each bar key on a stream, and no record later than `delay`.

    The watermark follows the latest date seen, less `delay`. A key is remembered until the
    watermark is `delay` past its date, so the state holds the bars of about twice `delay`,
    however long the stream. A record whose date lies before the watermark is dropped and
    counted (see `late_rows`), since its key may be forgotten; records without a date have
    no place on a watermark and are dropped too.
    """
    timed = records.withColumn(_TIME, dated(F.col("trade_date"))).where(F.col(_TIME).isNotNull())
    return timed.withWatermark(_TIME, delay).dropDuplicatesWithinWatermark(list(key)).drop(_TIME)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's recent batches dropped for being late."""
    return sum(
        operator["numRowsDroppedByWatermark"] for p in query.recentProgress for operator in p["stateOperators"]
    )


def state_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful steps hold after its last batch."""
    progress = query.lastProgress
    return sum(operator["numRowsTotal"] for operator in progress["stateOperators"]) if progress else 0


def with_reason(messages: DataFrame) -> DataFrame:
    """Parsed messages with their text and, where they are to be rejected, the reason: no
    usable code, or the names of missing prices."""
    rows = M.parsed(messages, keep_value=True)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    reason = F.when(F.col("ts_code").isNull(), F.lit(UNREADABLE)).when(
        missing != "", F.concat(F.lit("without "), missing)
    )
    return rows.withColumn("reason", reason)


def start_intake(
    messages: DataFrame,
    accepted: str,
    rejected: str,
    progress: str,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch's records to `accepted`, and to `rejected` the messages that are
    none, with the reason.

    A batch is parsed once for both. Each output has a folder for each batch, which a batch
    that runs again overwrites, so no message is in both, in neither or in one twice.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = with_reason(batch).persist()
        try:
            fields = M.MESSAGE_SCHEMA.fieldNames()
            good = rows.where("reason is null").select(*fields)
            good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
            bad = rows.where("reason is not null").select(*REJECT_SCHEMA.fieldNames())
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        finally:
            rows.unpersist()

    pace = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        messages.writeStream.foreachBatch(process)
        .option("checkpointLocation", progress)
        .trigger(**pace)
        .start()
    )
