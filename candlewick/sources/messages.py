"""Messages: bars as JSON, one object per record, on a topic or in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.sources.bars import BAR_SCHEMA

# A message may name its volume `vol` or `volume`.
MESSAGE_SCHEMA = T.StructType(BAR_SCHEMA.fields + [T.StructField("volume", T.DoubleType())])
# Topic names.
BAR_TOPIC = "stock_data"
INDICATOR_TOPIC = "stock_indicators"
# Messages of a packed file, which one task reads: some 10 MB.
FILE_ROWS = 250_000


def encode(rows: DataFrame) -> DataFrame:
    """Rows as a single ``value`` column of JSON text; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parsed(
    messages: DataFrame, schema: T.StructType = MESSAGE_SCHEMA, keep_value: bool = False
) -> DataFrame:
    """Typed rows from JSON messages (text or bytes), one each; all nulls if malformed.

    NaN counts as missing. With `keep_value` the message's text goes along.
    """
    # Generated rows keep later filters above the parser, so each message is
    # parsed once; a plain struct column would be parsed again by every filter.
    text = F.col("value").cast("string")
    kept = [text.alias("value")] if keep_value else []
    rows = messages.select(*kept, F.inline(F.array(F.from_json(text, schema))))
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def decode(
    messages: DataFrame,
    schema: T.StructType = MESSAGE_SCHEMA,
    watch: Observation | str | None = None,
) -> DataFrame:
    """The rows of `parsed` that have a code.

    Messages without a usable ``ts_code``, malformed ones included, are dropped; ``watch``
    counts them while the rows pass (a name on a stream, whose progress then reports the
    counts).
    """
    rows = parsed(messages, schema)
    if watch is not None:
        rows = rows.observe(
            watch,
            F.count(F.lit(1)).alias("n_messages"),
            F.count_if(F.col("ts_code").isNull()).alias("n_unreadable"),
        )
    return rows.where(F.col("ts_code").isNotNull())


def topic_stream(
    spark: SparkSession, servers: str, topic: str = BAR_TOPIC, **options: str
) -> DataFrame:
    """Message stream of a Kafka topic (needs Spark's Kafka connector)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
        .select("value")
    )


def folder_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Message stream of a folder of text files; ``files_per_batch`` paces a replay."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def write_folder(
    messages: DataFrame,
    folder: str,
    mode: str = "append",
    compression: str = "none",
    file_rows: int = 0,
) -> None:
    """Text files, one a task, or one for every so many rows. A packed file (`gzip`) is read by
    one task, so each should be small."""
    writer = messages.write.mode(mode).option("maxRecordsPerFile", file_rows)
    writer.text(folder, compression=compression)


def write_topic(messages: DataFrame, servers: str, topic: str = INDICATOR_TOPIC) -> None:
    """Batch write to a Kafka topic (needs Spark's Kafka connector)."""
    (
        messages.select("value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
