"""Scalar building blocks of the indicators, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain_of(delta: Column) -> Column:
    """Upward part of a price change; no change known counts as zero."""
    return F.when(delta > 0, delta).otherwise(F.lit(0.0))


def loss_of(delta: Column) -> Column:
    """Downward part of a price change as a positive number; unknown counts as zero."""
    return F.when(delta < 0, -delta).otherwise(F.lit(0.0))


def relative_strength(avg_gain: Column, avg_loss: Column) -> Column:
    """Mean gain over mean loss; null where there was no loss."""
    return F.try_divide(avg_gain, avg_loss)


def rsi_of(rs: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)


def rsv_of(close: Column, highest: Column, lowest: Column) -> Column:
    """Place of the close inside the high-low range in percent; 50 for a flat range."""
    inside = F.try_divide(close - lowest, highest - lowest) * 100.0
    return F.when(close.isNull(), None).when(highest == lowest, 50.0).otherwise(inside)


def smooth(previous: Column, value: Column) -> Column:
    """Two thirds of the previous value plus one third of the new one."""
    return F.lit(2 / 3) * previous + F.lit(1 / 3) * value


def j_of(k: Column, d: Column) -> Column:
    return 3.0 * k - 2.0 * d


def trend_of(close: Column, level: Column) -> Column:
    """1 above the level, otherwise (also for an unknown price) -1."""
    return F.when(close > level, F.lit(1)).otherwise(F.lit(-1))


def extreme_of(trend: Column, high: Column, low: Column) -> Column:
    return F.when(trend == 1, high).otherwise(low)


def step_toward(level: Column, target: Column, factor: Column | float) -> Column:
    return level + (target - level) * factor


def panel_text(value: Column) -> Column:
    """Two decimals, or ``--`` for a value that is null, NaN or zero.

    Rounds the number itself, not its shortest decimal form: 83380.185 lies below the half
    and gives 83380.18. Only exact halves are ties, and go to the even digit.
    """
    missing = value.isNull() | F.isnan(value) | (value == 0)
    text = F.call_function("format_number", value, F.lit("0.00"))
    return F.when(missing, F.lit("--")).otherwise(text)
