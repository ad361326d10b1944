"""Stored history: enriched rows as parquet, split by month of ``trade_date``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_history(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Store rows by month, in code and date order inside each file.

    The rebalance splits a large month over several files and joins small ones;
    the order keeps row-group statistics on ``ts_code`` tight.
    """
    (
        rows.withColumn("month", F.substring("trade_date", 1, 6))
        .hint("rebalance", "month")
        .sortWithinPartitions("month", "ts_code", "trade_date")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(folder)
    )


def upsert_history(
    spark: SparkSession,
    rows: DataFrame,
    folder: str,
    key: tuple[str, ...] = ("ts_code", "trade_date"),
) -> None:
    """Put rows into a stored history: a row replaces the stored one of its key.

    Only the months that `rows` has are read and written again; the files of others stay as
    they are. Written is a new version of each month, which replaces the old one when the
    whole job is done, so a job that fails changes nothing, and one that runs again writes
    the same. Of rows that repeat a key the largest stays, column by column. The history
    must have the columns of `rows`.
    """
    rows = rows.withColumn("month", F.substring("trade_date", 1, 6))
    fields = [c for c in rows.columns if c not in key]
    try:
        stored = spark.read.schema(rows.schema).parquet(folder)
    except AnalysisException:
        stored = None
    dealt = rows.withColumn("_rank", F.lit(1))
    if stored is not None:
        # One value a month: a century has 1,200 of them.
        touched = [r.month for r in rows.select("month").distinct().collect()]
        known = [m for m in touched if m]
        some = F.col("month").isin(known)
        # Undated rows are stored under no month.
        some = some | F.col("month").isNull() if len(known) < len(touched) else some
        older = stored.where(some).withColumn("_rank", F.lit(0))
        dealt = dealt.unionByName(older.withColumn("month", F.coalesce("month", F.lit(""))))
    # An undated row's key is null or empty text before it is stored, and null after.
    order = F.struct("_rank", *fields)
    newest = dealt.groupBy(*key).agg(F.max(order).alias("_newest"))
    merged = newest.select(*key, *[F.col(f"_newest.{c}").alias(c) for c in fields])
    (
        merged.select(*rows.columns)
        .hint("rebalance", "month")
        .sortWithinPartitions("month", *key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(folder)
    )


def look_up(
    spark: SparkSession,
    folder: str,
    ts_code: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """Stored rows by code and inclusive date range; only the months needed are read.

    Rows with an empty date come before every start; their month is stored as null.
    """
    rows = spark.read.parquet(folder)
    month = F.col("month").cast("string")
    if ts_code:
        rows = rows.where(F.col("ts_code") == ts_code)
    if start_date:
        rows = rows.where((month >= start_date[:6]) & (F.col("trade_date") >= start_date))
    if end_date:
        rows = rows.where(
            (month.isNull() | (month <= end_date[:6])) & (F.col("trade_date") <= end_date)
        )
    return rows.drop("month")
