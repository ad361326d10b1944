"""The bar table: its schema, bounded scans of it, and adapters that build it.

A bar is one row per (``ts_code``, ``trade_date``) with prices and volume.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.plans.layout import DAILY, HOURLY, SeriesLayout, with_context, without_context

# The field names and types of one bar message, in order.
BAR_SCHEMA = T.StructType(
    [
        T.StructField("ts_code", T.StringType()),
        T.StructField("trade_date", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("pre_close", T.DoubleType()),
        T.StructField("change", T.DoubleType()),
        T.StructField("pct_chg", T.DoubleType()),
        T.StructField("vol", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
    ]
)
BAR_FIELDS = tuple(BAR_SCHEMA.fieldNames())
# Bar fields that need the bar before.
_CHAINED = frozenset({"pre_close", "change", "pct_chg"})
HISTORY_FIELDS = ("ts_code", "trade_date", "close", "high", "low", "vol")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stored bar table in any file format Spark reads, with the declared schema."""
    return spark.read.format(fmt).schema(BAR_SCHEMA).options(**options).load(path)


def scan_bars(
    bars: DataFrame,
    ts_code: str | None = None,
    trade_date: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    offset: int | None = None,
    limit: int | None = None,
    fields: tuple[str, ...] = BAR_FIELDS,
) -> DataFrame:
    """Bounded scan: code equality, exact date, inclusive date range, paging, field list.

    An argument left out (or given as an empty string) does not restrict the
    scan.  The predicates are plain column comparisons, so they reach a parquet
    scan as pushed filters together with the pruned field list.
    """
    rows = bars
    if ts_code:
        rows = rows.where(F.col("ts_code") == ts_code)
    if trade_date:
        rows = rows.where(F.col("trade_date") == trade_date)
    if start_date:
        rows = rows.where(F.col("trade_date") >= start_date)
    if end_date:
        rows = rows.where(F.col("trade_date") <= end_date)
    rows = rows.select(*fields)
    # A limit of 0 is one: it asks for no rows.
    paged = [value is not None and value != "" for value in (offset, limit)]
    if any(paged):
        rows = rows.orderBy("ts_code", "trade_date")
        rows = rows.offset(offset) if paged[0] else rows
        rows = rows.limit(limit) if paged[1] else rows
    return rows


def scan_history(bars: DataFrame, **bounds: str) -> DataFrame:
    """Narrow scan for a history preload; ``vol`` is stored as ``volume``."""
    return scan_bars(bars, fields=HISTORY_FIELDS, **bounds).withColumnRenamed("vol", "volume")


def daily_bars(
    lineitem: DataFrame,
    layout: SeriesLayout = DAILY,
    ts_code: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    fields: tuple[str, ...] = BAR_FIELDS,
) -> DataFrame:
    """Daily bars per supplier from order lines (price = extended price).

    Code and inclusive dates bound the lines that are read. The start does so only if
    no field that looks back to an earlier bar is asked for; the bars are bounded anyway.
    """
    cents = (F.col("l_extendedprice") * 100 + 0.5).cast("long")
    lines = _bounded(lineitem, "l_shipdate", "%Y%m%d", timedelta(days=1), start_date, end_date, fields)
    if ts_code and ts_code.isdigit():
        lines = lines.where(F.col("l_suppkey") == int(ts_code))
    bars = _resample(
        lines,
        series=F.col("l_suppkey"),
        bucket=F.to_date("l_shipdate"),
        stamp=F.date_format("_bucket", "yyyyMMdd"),
        price=F.col("l_extendedprice"),
        volume=F.col("l_quantity"),
        order=_rank(
            (F.col("l_orderkey"), 12), (F.col("l_linenumber"), 5), (F.col("l_partkey"), 11), (cents, 10)
        ),
        layout=layout,
        fields=fields,
    )
    return scan_bars(bars, ts_code, start_date=start_date, end_date=end_date, fields=fields)


def hourly_bars(
    events: DataFrame,
    layout: SeriesLayout = HOURLY,
    ts_code: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    fields: tuple[str, ...] = BAR_FIELDS,
) -> DataFrame:
    """Hourly bars per event type from the event log (price = value).

    Hours are those of the stored, zone-free time, whatever the session's zone. Bounds
    (`yyyyMMddHH`) work as for `daily_bars`.
    """
    rows = _bounded(events, "ts", "%Y%m%d%H", timedelta(hours=1), start_date, end_date, fields)
    if ts_code:
        rows = rows.where(F.col("event_type") == ts_code)
    day, hour = F.unix_date(F.to_date("ts")).cast("long"), F.hour("ts").cast("long")
    in_hour = F.minute("ts").cast("long") * 60_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    bucket = F.col("_bucket")
    bars = _resample(
        rows,
        series=F.col("event_type"),
        bucket=day * 24 + hour,
        stamp=F.concat(
            F.date_format(F.date_from_unix_date(F.floor(bucket / 24).cast("int")), "yyyyMMdd"),
            F.lpad(F.pmod(bucket, F.lit(24)).cast("string"), 2, "0"),
        ),
        price=F.col("value"),
        volume=F.lit(1.0),
        order=_rank(((day * 24 + hour) * 3_600_000_000 + in_hour, 19), (F.col("event_id"), 19)),
        layout=layout,
        fields=fields,
    )
    return scan_bars(bars, ts_code, start_date=start_date, end_date=end_date, fields=fields)


def _bounded(
    rows: DataFrame,
    column: str,
    form: str,
    width: timedelta,
    start_date: str | None,
    end_date: str | None,
    fields: tuple[str, ...],
) -> DataFrame:
    """The rows whose raw time can fall into the bounds, as comparisons a scan can push.

    A bound that is not a whole date is left to the comparison of the bars' dates.
    """
    kind = rows.schema[column].dataType.simpleString()

    def at(bound: str | None, later: timedelta) -> Column | None:
        try:
            moment = datetime.strptime(bound or "", form) + later
        except (ValueError, OverflowError):
            return None
        if moment.strftime(form) != bound and not later:
            return None
        return F.expr(f"{kind}'{moment:%Y-%m-%d %H:%M:%S}'")

    end, start = at(end_date, width), at(start_date, timedelta())
    if end is not None:
        rows = rows.where(F.col(column) < end)
    if start is not None and not _CHAINED & set(fields):
        rows = rows.where(F.col(column) >= start)
    return rows


def _rank(*parts: tuple[Column, int]) -> Column:
    """One decimal that sorts like the given non-negative (column, digits) parts.

    First and last price by a struct would make the aggregate sort its input;
    a decimal is a fixed-width buffer, so it stays a hash aggregate.  A part with
    more digits than declared fails the cast instead of sorting wrongly.
    """
    rank, below = None, 0
    for part, digits in reversed(parts):
        digit_group = part.cast(f"decimal({digits},0)").cast("decimal(38,0)")
        if rank is not None:
            digit_group = digit_group * F.lit(Decimal(10**below))
        rank = digit_group if rank is None else digit_group + rank
        below += digits
    return rank


def _resample(
    rows: DataFrame,
    series: Column,
    bucket: Column,
    stamp: Column,
    price: Column,
    volume: Column,
    order: Column,
    layout: SeriesLayout,
    fields: tuple[str, ...],
) -> DataFrame:
    # Grouping by the raw key and bucket keeps the shuffled keys narrow, and all
    # aggregates merge, so a hot key is reduced before the shuffle.
    bars = (
        rows.select(
            series.alias("_series"),
            bucket.alias("_bucket"),
            price.alias("_price"),
            volume.alias("_volume"),
            order.alias("_order"),
        )
        .groupBy("_series", "_bucket")
        .agg(
            F.min_by("_price", "_order").alias("open"),
            F.max("_price").alias("high"),
            F.min("_price").alias("low"),
            F.max_by("_price", "_order").alias("close"),
            F.sum("_volume").alias("vol"),
            F.round(F.sum("_price"), 2).alias("amount"),
        )
        .select(
            F.col("_series").cast("string").alias("ts_code"),
            stamp.alias("trade_date"),
            "open",
            "high",
            "low",
            "close",
            "vol",
            "amount",
        )
    )
    if not _CHAINED & set(fields):
        return bars
    previous = F.lag("close").over(layout.window())
    return without_context(
        with_context(bars, 1, layout)
        .withColumn("pre_close", previous)
        .withColumn("change", F.col("close") - F.col("pre_close"))
        .withColumn("pct_chg", F.try_divide("change", "pre_close") * 100)
    ).select(*BAR_FIELDS)
