"""Hand-made series with expected values, and plain-Python forms of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.sources.bars import BAR_FIELDS, BAR_SCHEMA

# trade_date, high, low, close, vol, rsi, psar_step, k, d, j, obv, psar
GOLDEN = [
    ("20250101", 10.5, 10.0, 10.2, 1000.0, None, 10.196, None, None, None, None, None),
    ("20250102", 10.8, 10.2, 10.7, 1100.0, None, 10.212, None, None, None, None, None),
    ("20250103", 11.0, 10.5, 10.9, 1200.0, None, 10.216, None, None, None, None, None),
    ("20250104", 11.4, 10.9, 11.0, 1300.0, None, 10.224, None, None, None, None, None),
    ("20250105", 11.2, 10.7, 10.8, 1400.0, 80.0, 10.220, None, None, None, None, None),
    ("20250106", 10.9, 10.3, 10.4, 1500.0, 57.142857, 10.214, None, None, None, None, None),
    ("20250107", 10.6, 10.1, 10.2, 1600.0, 50.0, 10.198, None, None, None, None, None),
    ("20250108", 10.4, 9.9, 10.3, 1700.0, 52.941176, 10.204, None, None, None, None, None),
    ("20250109", 10.7, 10.1, 10.6, 1800.0, 60.0, 10.210, None, None, None, None, None),
    ("20250110", 11.1, 10.6, 11.0, 1900.0, 66.666667, 10.218, None, None, None, None, None),
    ("20250111", 11.6, 11.0, 11.5, 2000.0, 72.413793, 10.228, None, None, None, None, None),
    ("20250112", 12.0, 11.5, 11.9, 2100.0, 75.757576, 10.236, None, None, None, None, None),
    ("20250113", 12.3, 11.8, 11.9, 2200.0, 75.757576, 10.242, None, None, None, None, None),
    ("20250114", 12.1, 11.5, 11.6, 2300.0, 69.444444, 10.238, None, None, None, None, None),
    ("20250115", 11.7, 11.0, 11.1, 2400.0, 60.975610, 10.230, 50.0, 50.0, 50.0, 25500.0, 10.447719),
    ("20250116", 11.2, 10.6, 10.7, 2500.0, 55.555556, 10.220, 44.444444, 48.148148, 37.037037, 28000.0, 12.3),
    ("20250117", 10.8, 10.2, 10.3, 2600.0, 45.454545, 10.212, 36.363636, 45.454545, 18.181818, 30600.0, 12.266),
    ("20250118", 10.5, 10.0, 10.4, 2700.0, 44.186047, 10.206, 39.130435, 46.376812, 24.637681, 33300.0, 12.18336),
    ("20250119", 10.9, 10.3, 10.8, 2800.0, 47.826087, 10.214, 44.927536, 48.309179, 38.164251, 36100.0, 11.919688),
    ("20250120", 11.5, 10.9, 11.4, 2900.0, 56.0, 10.226, 53.623188, 51.207729, 58.454106, 39000.0, 11.603725),
]
# rows: K, D, J, PSAR, OBV of the list form over the first rows
GOLDEN_LISTS = {
    1: (None, None, None, 10.2, 1000.0),
    2: (None, None, None, 10.5, 2100.0),
    8: (None, None, None, 11.32688, 10800.0),
    9: (48.888889, 49.629630, 47.407407, 11.241267, 12600.0),
    10: (57.037037, 52.098765, 66.913580, 11.160791, 14500.0),
    15: (67.867415, 70.644275, 62.313695, 10.282423, 25500.0),
    20: (42.625741, 43.546294, 40.784635, 12.080973, 39000.0),
}


def bars_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Bars with the named fields; everything else null."""
    full = [tuple(row.get(name) for name in BAR_FIELDS) for row in rows]
    return spark.createDataFrame(full, BAR_SCHEMA)


def series(code: str, prices: list[tuple], first_day: int = 20250101) -> list[dict]:
    """Rows from (high, low, close, vol) tuples on consecutive date strings."""
    return [
        dict(ts_code=code, trade_date=str(first_day + i), high=h, low=lo, close=c, vol=v)
        for i, (h, lo, c, v) in enumerate(prices)
    ]


def golden_rows(code: str = "X", count: int = 20) -> list[dict]:
    return series(code, [(g[1], g[2], g[3], g[4]) for g in GOLDEN[:count]])


def near(got, want, tolerance: float = 1e-6) -> bool:
    if got is None or want is None:
        return got is None and want is None
    return abs(got - want) <= tolerance * max(1.0, abs(want))


# -- brute force over a list of (high, low, close) --------------------------------


def list_psar(bars: list[tuple], step: float = 0.02, ceiling: float = 0.2) -> float:
    (extreme, _, level), rising, speed = bars[0], True, step
    for high, low, _ in bars[1:]:
        level += speed * (extreme - level)
        ahead, behind = (high, low) if rising else (low, high)
        sign = 1 if rising else -1
        if sign * behind < sign * level:
            level, extreme, rising, speed = extreme, behind, not rising, step
        elif sign * ahead > sign * extreme:
            extreme, speed = ahead, min(speed + step, ceiling)
    return level


def list_kdj(bars: list[tuple], period: int = 9):
    if len(bars) < period:
        return None, None, None
    k = d = 50.0
    for end in range(period, len(bars) + 1):
        frame = bars[end - period : end]
        top, bottom = max(b[0] for b in frame), min(b[1] for b in frame)
        place = 50.0 if top == bottom else (frame[-1][2] - bottom) / (top - bottom) * 100
        k = k * 2 / 3 + place / 3
        d = d * 2 / 3 + k / 3
    return k, d, 3 * k - 2 * d
