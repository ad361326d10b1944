"""The indicators as column sets over rows that carry context.

``add_*`` functions take rows prepared by ``with_context`` and can be stacked, so
that several indicators share one exchange and one sort.  The plain-named
functions are the DataFrame-to-DataFrame transforms built on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import expressions as E
from candlewick.functions import stop_and_reverse as sar
from candlewick.functions.tails import KDJ_PERIOD, kdj_columns
from candlewick.operators.windows import (
    first_close,
    last_rows,
    position,
    volume_so_far,
)
from candlewick.plans.layout import SeriesLayout, with_context, without_context

# Look-back of the mean gain and loss, and rows in the PSAR list.
RSI_PERIOD = 14
PSAR_ROWS = 10


def add_average_moves(rows: DataFrame, layout: SeriesLayout, period: int) -> DataFrame:
    """Mean gain and loss over the current row and ``period`` rows before it."""
    frame = last_rows(layout, period + 1)
    return (
        rows.withColumn("delta", F.col("close") - F.lag("close", 1).over(layout.window()))
        .withColumns(
            {"gain": E.gain_of(F.col("delta")), "loss": E.loss_of(F.col("delta"))}
        )
        .withColumns(
            {"avg_gain": F.avg("gain").over(frame), "avg_loss": F.avg("loss").over(frame)}
        )
    )


def add_rsi(rows: DataFrame, layout: SeriesLayout, period: int = RSI_PERIOD) -> DataFrame:
    return (
        add_average_moves(rows, layout, period)
        .withColumn("rs", E.relative_strength(F.col("avg_gain"), F.col("avg_loss")))
        .withColumn("rsi", E.rsi_of(F.col("rs")))
    )


def add_step_psar(
    rows: DataFrame, layout: SeriesLayout, acceleration: float = sar.AF_STEP
) -> DataFrame:
    """One step from the first close of the series toward the bar's extreme."""
    return (
        rows.withColumn("_start", first_close(layout))
        .withColumn("trend", E.trend_of(F.col("close"), F.col("_start")))
        .withColumn("extreme_point", E.extreme_of(F.col("trend"), F.col("high"), F.col("low")))
        .withColumn("psar", E.step_toward(F.col("_start"), F.col("extreme_point"), acceleration))
        .drop("_start")
    )


def add_rsv(rows: DataFrame, layout: SeriesLayout, period: int = KDJ_PERIOD) -> DataFrame:
    """Range position; null before ``period`` rows exist or if the frame has a gap."""
    frame = last_rows(layout, period)
    whole = (F.col("_highs") == period) & (F.col("_lows") == period)
    rsv = E.rsv_of(F.col("close"), F.col("_highest"), F.col("_lowest"))
    return (
        rows.withColumns(
            {
                "_highest": F.max("high").over(frame),
                "_lowest": F.min("low").over(frame),
                "_highs": F.count("high").over(frame),
                "_lows": F.count("low").over(frame),
            }
        )
        .withColumn("rsv", F.when(whole, rsv))
        .drop("_highest", "_lowest", "_highs", "_lows")
    )


def add_kdj(rows: DataFrame, layout: SeriesLayout, period: int = KDJ_PERIOD) -> DataFrame:
    """KDJ of exactly the last ``period`` rows: a single smoothing step from 50."""
    return (
        add_rsv(rows, layout, period)
        .withColumns(kdj_columns(F.col("rsv")))
        .drop("rsv")
    )


def add_obv(rows: DataFrame, layout: SeriesLayout) -> DataFrame:
    return rows.withColumn("obv", volume_so_far(layout))


def add_psar(
    rows: DataFrame,
    layout: SeriesLayout,
    size: int = PSAR_ROWS,
    af_step: float = sar.AF_STEP,
    af_max: float = sar.AF_MAX,
) -> DataFrame:
    """Stop-and-reverse level of the last ``size`` rows (fewer at the series start).

    The recursion restarts in every frame, so a frame holds all it needs.
    """
    frame = last_rows(layout, size)
    bar = F.struct("high", "low", "close")
    known = F.count(F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), 1))
    level = sar.fold(F.col("_frame"), af_step=af_step, af_max=af_max).getField("p")
    return (
        rows.withColumns(
            {"_frame": F.collect_list(bar).over(frame), "_known": known.over(frame)}
        )
        # A null first close makes the level null by itself.
        .withColumn("psar", F.when(F.col("_known") == F.size("_frame"), level))
        .drop("_frame", "_known")
    )


def average_moves(
    bars: DataFrame, layout: SeriesLayout, period: int = RSI_PERIOD
) -> DataFrame:
    rows = with_context(bars, period + 1, layout)
    return without_context(add_average_moves(rows, layout, period))


def rsi(bars: DataFrame, layout: SeriesLayout, period: int = RSI_PERIOD) -> DataFrame:
    return without_context(add_rsi(with_context(bars, period + 1, layout), layout, period))


def step_psar(
    bars: DataFrame, layout: SeriesLayout, acceleration: float = sar.AF_STEP
) -> DataFrame:
    return without_context(add_step_psar(with_context(bars, 1, layout), layout, acceleration))


def kdj(bars: DataFrame, layout: SeriesLayout, period: int = KDJ_PERIOD) -> DataFrame:
    return without_context(add_kdj(with_context(bars, period - 1, layout), layout, period))


def psar(bars: DataFrame, layout: SeriesLayout, size: int = PSAR_ROWS) -> DataFrame:
    return without_context(add_psar(with_context(bars, size - 1, layout), layout, size))
