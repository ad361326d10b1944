"""Window columns over rows that carry context (see ``plans.layout``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tails import KDJ_PERIOD
from candlewick.plans.layout import (
    FIRST_CLOSE,
    N_INC,
    VOL_INC,
    SeriesLayout,
    with_context,
    without_context,
)



def position(layout: SeriesLayout) -> Column:
    """1-based row number in the whole series."""
    return F.sum(N_INC).over(layout.running())


def volume_so_far(layout: SeriesLayout) -> Column:
    return F.sum(VOL_INC).over(layout.running())


def first_close(layout: SeriesLayout) -> Column:
    return F.first(FIRST_CLOSE).over(layout.running())


def last_rows(layout: SeriesLayout, rows: int):
    """Frame of the current row and the ``rows - 1`` before it."""
    return layout.window().rowsBetween(-(rows - 1), 0)


def price_delta(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    rows = with_context(bars, 1, layout)
    delta = F.col("close") - F.lag("close", 1).over(layout.window())
    return without_context(rows.withColumn("delta", delta))


def running_volume(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    rows = with_context(bars, 1, layout)
    return without_context(rows.withColumn("obv", volume_so_far(layout)))


def rolling_extremes(
    bars: DataFrame, layout: SeriesLayout, period: int = KDJ_PERIOD
) -> DataFrame:
    rows = with_context(bars, period - 1, layout)
    frame = last_rows(layout, period)
    return without_context(
        rows.withColumns(
            {"highest": F.max("high").over(frame), "lowest": F.min("low").over(frame)}
        )
    )
