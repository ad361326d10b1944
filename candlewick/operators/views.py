"""Tables behind the live view: the latest-value panel and the chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.expressions import panel_text
from candlewick.functions.tails import kdj_columns, psar_of_tail, rsv_of_tail
from candlewick.operators.aggregates import series_state
from candlewick.operators.rows import ENRICHED, WARMUP
from candlewick.plans.layout import SeriesLayout

# Chart, series and column of each line drawn.
CHART_SERIES = (
    ("price", "close", "close"),
    ("kdj", "K", "k"),
    ("kdj", "D", "d"),
    ("kdj", "J", "j"),
    ("obv", "OBV", "obv"),
    ("psar", "close", "close"),
    ("psar", "PSAR", "psar"),
)


def from_state(state: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Add ``k, d, j, obv, psar`` of the newest bar to rows of ``n, obv, tail``."""
    values = {
        **kdj_columns(F.col("_rsv")),
        "psar": psar_of_tail(F.col("tail")),
        "obv": F.col("obv"),
    }
    gated = {name: F.when(F.col("n") > warmup, value) for name, value in values.items()}
    return state.withColumn("_rsv", rsv_of_tail(F.col("tail"))).withColumns(gated).drop("_rsv")


def latest_values(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Newest indicator values per series.

    Only the last ten bars of a series and its totals matter, so they are reduced
    before the shuffle instead of enriching every bar and keeping the last.
    """
    newest = F.try_element_at("tail", F.lit(-1)).getField("trade_date")
    return from_state(series_state(bars, layout)).select(
        layout.key, newest.alias("trade_date"), *ENRICHED
    )


def panel(latest: DataFrame) -> DataFrame:
    """The latest values as displayed."""
    return latest.withColumns({c: panel_text(F.col(c)) for c in ENRICHED})


def chart_series(enriched: DataFrame) -> DataFrame:
    """Enriched rows in long form: one row per chart point."""
    points = ", ".join(f"'{chart}', '{name}', {column}" for chart, name, column in CHART_SERIES)
    return enriched.selectExpr(
        "ts_code",
        "trade_date AS x",
        f"stack({len(CHART_SERIES)}, {points}) AS (chart, series, y)",
    )
