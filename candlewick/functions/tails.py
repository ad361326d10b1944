"""Indicators of one row from an array of the last bars of its series.

Used where the rows before are held as state instead of being in a window frame:
the latest row per series and the stateful stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick.functions import expressions as E
from candlewick.functions import stop_and_reverse as sar

# Rows in the KDJ frame, and K and D before the first value.
KDJ_PERIOD = 9
KD_START = 50.0


def rsv_of_tail(tail: Column, period: int = KDJ_PERIOD) -> Column:
    """Range position of the last bar; null if bars are missing or have a gap."""
    frame = F.slice(tail, F.greatest(F.size(tail) - period + 1, F.lit(1)), period)
    gap = F.exists(frame, lambda b: b.getField("high").isNull() | b.getField("low").isNull())
    close = F.try_element_at(frame, F.lit(-1)).getField("close")
    rsv = E.rsv_of(
        close, F.array_max(frame.getField("high")), F.array_min(frame.getField("low"))
    )
    return F.when((F.size(frame) == period) & ~gap, rsv)


def kdj_columns(rsv: Column) -> dict[str, Column]:
    """K, D and J one smoothing step after the start value."""
    k = E.smooth(F.lit(KD_START), rsv)
    d = E.smooth(F.lit(KD_START), k)
    return {"k": k, "d": d, "j": E.j_of(k, d)}


def psar_of_tail(tail: Column) -> Column:
    """Stop-and-reverse level after the last bar of the array."""
    gap = F.exists(tail, lambda b: b.getField("high").isNull() | b.getField("low").isNull())
    return F.when((F.size(tail) > 0) & ~gap, sar.fold(tail).getField("p"))
