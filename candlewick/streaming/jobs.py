"""Streaming jobs: indicators per micro-batch, and enrichment with per-series state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from candlewick.functions.stop_and_reverse import AF_MAX, AF_STEP
from candlewick.functions.tails import KDJ_PERIOD
from candlewick.operators.aggregates import series_state
from candlewick.operators.indicators import PSAR_ROWS
from candlewick.operators.rows import WARMUP, enriched_records, indicator_rows
from candlewick.operators.views import from_state
from candlewick.plans.layout import N_INC, VOL_INC, SeriesLayout, increments
from candlewick.plans.shipping import ship_package
from candlewick.sources import messages as M
from candlewick.sources.bars import BAR_FIELDS, BAR_SCHEMA
from candlewick.streaming.state import ROW_SCHEMA, RecentBars, tail_column
from candlewick.streaming.state_log import BUCKETS, StateLog

# The fields of an enriched record and of an indicator message.
ENRICHED_SCHEMA = T.StructType(
    BAR_SCHEMA.fields
    + [T.StructField("volume", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("k", "d", "j", "obv", "psar")]
)
INDICATOR_SCHEMA = T.StructType(
    [
        T.StructField("ts_code", T.StringType()),
        T.StructField("trade_date", T.StringType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("rsi", T.DoubleType()),
        T.StructField("psar", T.DoubleType()),
    ]
)

# The store that stateful processors need.
STATE_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Sink = Callable[[DataFrame, int], None]


# -- sinks ------------------------------------------------------------------------


def folder_sink(folder: str) -> Sink:
    """Messages of each micro-batch in a folder of their own, packed.

    A batch that runs again after a failure overwrites what it wrote before.
    """

    def write(messages: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch={batch_id}"
        M.write_folder(messages, path, "overwrite", "gzip", M.FILE_ROWS)

    return write


def read_folder_sink(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select("value")


def topic_sink(servers: str, topic: str = M.INDICATOR_TOPIC) -> Sink:
    """Messages of each micro-batch to a Kafka topic (at least once)."""
    return lambda messages, batch_id: M.write_topic(messages, servers, topic)


def append_to_folder(
    rows: DataFrame, folder: str, progress: str, processing_time: str | None = None
) -> StreamingQuery:
    """Parquet sink with exactly-once file commits; drains the source if not paced."""
    pace = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(**pace)
        .start(folder)
    )


# -- indicators per micro-batch ------------------------------------------------------


def start_batch_indicators(
    bars: DataFrame,
    sink: Sink,
    progress: str,
    layout: SeriesLayout = SeriesLayout(),
    processing_time: str | None = None,
) -> StreamingQuery:
    """RSI and step PSAR over each micro-batch, published as JSON messages.

    History is the micro-batch alone.  A failing batch stops the query, which
    then resumes at that batch from its checkpoint.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        sink(M.encode(indicator_rows(batch, layout)), batch_id)

    pace = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        bars.writeStream.foreachBatch(process)
        .option("checkpointLocation", progress)
        .trigger(**pace)
        .start()
    )


# -- enrichment, state as a table -------------------------------------------------------

# Carried bars (0) keep their places; of a micro-batch (1) dated bars come first, in date
# order, and undated ones after them.
_ARRIVAL = ("src_seq", "pos", "trade_date")
TABLE_STATE = T.StructType(
    [
        T.StructField("ts_code", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("obv", T.DoubleType()),
        T.StructField(
            "tail",
            T.ArrayType(
                T.StructType(
                    [T.StructField("trade_date", T.StringType())]
                    + [T.StructField(c, T.DoubleType()) for c in ("high", "low", "close")]
                )
            ),
        ),
    ]
)


def table_state(
    bars: DataFrame, layout: SeriesLayout = SeriesLayout(), rows: int = PSAR_ROWS
) -> DataFrame:
    """State of every series after the given bars, in the layout's order. `rows` is how many
    last bars it holds: as many as the longest look-back of the stream."""
    fields = ("trade_date", "high", "low", "close")
    bar = F.transform("tail", lambda b: F.struct(*(b.getField(c).alias(c) for c in fields)))
    return series_state(bars, layout, rows).select("ts_code", "n", "obv", bar.alias("tail"))


def start_enriched_batches(
    records: DataFrame,
    folder: str,
    state: str,
    progress: str,
    layout: SeriesLayout = SeriesLayout(),
    warm: DataFrame | None = None,
    processing_time: str | None = None,
    warmup: int = WARMUP,
    period: int = KDJ_PERIOD,
    size: int = PSAR_ROWS,
    af_step: float = AF_STEP,
    af_max: float = AF_MAX,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Enrich each micro-batch with the windows of the batch operators.

    The last bars and totals of every series are carried from batch to batch in a log under
    ``state`` (see `state_log`); those of the series a batch has enter its windows as rows
    before its own, and only theirs are written again.  All work is native and follows
    ``layout``, so a series that dominates a batch is split.  The history of a series is the
    order of arrival: carried bars keep their places, so how the bars fall into micro-batches
    changes nothing but the order within each.  Records leave as they came, with fields
    added.  A batch that runs again overwrites its output and writes the same state.

    The parameters are those of `enriched_records`; a ``warm`` state has to hold as many
    bars as the longer of ``period`` and ``size``.
    """
    spark = records.sparkSession
    layout = replace(layout, order=_ARRIVAL)
    held = max(period, size)
    log = StateLog(spark, state, TABLE_STATE, "ts_code", buckets)
    if warm is not None:
        log.start(warm)

    def process(batch: DataFrame, batch_id: int) -> None:
        log.clean(batch_id)
        # Read by the state, by three aggregations and by the windows below, decoded once.
        batch = batch.persist()
        try:
            carried = log.before(batch_id, batch.select("ts_code"))
            before = carried.select("ts_code", "n", "obv", "tail", F.posexplode("tail")).select(
                "ts_code",
                "col.*",
                "pos",
                F.lit(0).alias("src_seq"),
                # The oldest carried bar stands for all rows before it as well.
                F.when(F.col("pos") == 0, F.col("n") - F.size("tail") + 1)
                .otherwise(1)
                .alias(N_INC),
                F.when(F.col("pos") == 0, F.col("obv")).otherwise(0.0).alias(VOL_INC),
            )
            n_inc, vol_inc = increments(batch)
            undated = F.coalesce("trade_date", F.lit("")) == ""
            arrived = batch.withColumns(
                {"src_seq": F.lit(1), "pos": undated.cast("int"), N_INC: n_inc, VOL_INC: vol_inc}
            )
            rows = before.unionByName(arrived, allowMissingColumns=True)
            enriched = enriched_records(rows, layout, warmup, period, size, af_step, af_max)
            enriched.where(F.col("src_seq") == 1).select(*ENRICHED_SCHEMA.fieldNames()).write.mode(
                "overwrite"
            ).parquet(f"{folder}/batch={batch_id}")
            log.write(batch_id, table_state(rows, layout.whole(), held))
        finally:
            batch.unpersist()

    pace = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        records.select(*BAR_FIELDS, "volume")
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", progress)
        .trigger(**pace)
        .start()
    )


# -- enrichment, state in the state store -----------------------------------------------


def initial_state(history: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """State of every series after a bounded history."""
    recent = [F.col(f"tail.{c}").alias(f"recent_{c}") for c in ("high", "low", "close")]
    return series_state(history, layout, PSAR_ROWS - 1).select(layout.key, "n", "obv", *recent)


def enriched_stream(
    records: DataFrame, warm: DataFrame | None = None, warmup: int = WARMUP
) -> DataFrame:
    """Each record with ``k, d, j, obv, psar`` from all records before it.

    The stateful step only remembers: a row count, a volume and the last bars per
    series.  The indicators are native expressions on what it hands out.  Records leave
    as they came, with fields added.  Needs ``spark.sql.streaming.stateStore.providerClass``
    set to ``STATE_STORE``; it is the session's setting, so the caller's to make.
    """
    spark = records.sparkSession
    if spark.conf.get(STATE_STORE_SETTING, "") != STATE_STORE:
        raise ValueError(f"set {STATE_STORE_SETTING} to {STATE_STORE}")
    ship_package(spark)
    rows = (
        records.select(*BAR_FIELDS, "volume")
        .withColumn("counted", F.coalesce("vol", "volume", F.lit(0.0)))
        .groupBy("ts_code")
        .transformWithStateInPandas(
            statefulProcessor=RecentBars(),
            outputStructType=ROW_SCHEMA,
            outputMode="Append",
            timeMode="None",
            initialState=None if warm is None else warm.groupBy("ts_code"),
        )
    )
    return from_state(rows.withColumn("tail", tail_column()), warmup).select(*ENRICHED_SCHEMA.fieldNames())
