"""Record-level operators: filters, defaults, joins, unions and enriched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from candlewick.operators import indicators as I
from candlewick.operators.windows import position
from candlewick.plans.layout import SeriesLayout, with_context, without_context

# Rows a series needs before its records are enriched, and the
# fields a record must have.
WARMUP = 14
REQUIRED = ("close", "high", "low")
ENRICHED = ("k", "d", "j", "obv", "psar")


def required_fields(records: DataFrame, watch: Observation | str | None = None) -> DataFrame:
    """Records that carry every required price; ``watch`` counts the others."""
    complete = " AND ".join(f"{name} IS NOT NULL" for name in REQUIRED)
    if watch is not None:
        rejected = F.count_if(~F.expr(complete)).alias("n_rejected")
        records = records.observe(watch, rejected)
    return records.where(complete)


def with_defaults(records: DataFrame) -> DataFrame:
    """One ``volume`` from ``vol``, else ``volume``, else 0; empty text for no date."""
    volume = F.coalesce("vol", "volume", F.lit(0.0))
    return records.withColumns(
        {"volume": volume, "trade_date": F.coalesce("trade_date", F.lit(""))}
    ).drop("vol")


def indicator_rows(
    bars: DataFrame,
    layout: SeriesLayout,
    period: int = I.RSI_PERIOD,
    acceleration: float = I.sar.AF_STEP,
) -> DataFrame:
    """``ts_code, trade_date, close, rsi, psar`` in one windowed pass."""
    needed = bars.select(layout.key, *layout.order, "high", "low", "close")
    rows = I.add_rsi(with_context(needed, period + 1, layout), layout, period)
    rows = I.add_step_psar(rows, layout, acceleration)
    return without_context(rows).select(layout.key, *layout.order, "close", "rsi", "psar")


def indicator_join(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    """The same rows put together by joining bars, RSI and step PSAR on the bar key."""
    key = [layout.key, *layout.order]
    rsi = I.rsi(bars.select(*key, "close"), layout).select(*key, "rsi")
    psar = I.step_psar(bars.select(*key, "high", "low", "close"), layout).select(*key, "psar")
    return bars.select(*key, "close").join(rsi, key).join(psar, key)


def enriched_records(
    bars: DataFrame,
    layout: SeriesLayout,
    warmup: int = WARMUP,
    period: int = I.KDJ_PERIOD,
    size: int = I.PSAR_ROWS,
    af_step: float = I.sar.AF_STEP,
    af_max: float = I.sar.AF_MAX,
) -> DataFrame:
    """Bars plus ``k, d, j, obv, psar``, null until a series has more than ``warmup`` rows.

    ``period`` is KDJ's; ``size``, ``af_step`` and ``af_max`` are the stop-and-reverse
    level's. Chunks get as many rows of look-back as these need.
    """
    rows = with_context(bars, max(period, size) - 1, layout)
    rows = I.add_obv(I.add_kdj(rows, layout, period), layout)
    rows = I.add_psar(rows, layout, size, af_step, af_max)
    rows = rows.withColumn("_ready", position(layout) > warmup)
    rows = without_context(rows)
    return rows.withColumns({c: F.when(F.col("_ready"), F.col(c)) for c in ENRICHED}).drop("_ready")


def all_indicators(
    bars: DataFrame,
    layout: SeriesLayout,
    warmup: int = WARMUP,
    rsi_period: int = I.RSI_PERIOD,
    acceleration: float = I.sar.AF_STEP,
    period: int = I.KDJ_PERIOD,
    size: int = I.PSAR_ROWS,
    af_step: float = I.sar.AF_STEP,
    af_max: float = I.sar.AF_MAX,
) -> DataFrame:
    """Both indicator families in one wide row from one exchange and one sort.

    ``acceleration`` is the one-step level's; the rest as for the single operators.
    """
    keep = bars.columns
    rows = with_context(bars, max(rsi_period + 1, period - 1, size - 1), layout)
    rows = I.add_step_psar(I.add_rsi(rows, layout, rsi_period), layout, acceleration)
    rows = I.add_kdj(rows.withColumnRenamed("psar", "psar_step"), layout, period)
    rows = I.add_psar(I.add_obv(rows, layout), layout, size, af_step, af_max)
    rows = without_context(rows.withColumn("_ready", position(layout) > warmup))
    gated = [F.when(F.col("_ready"), F.col(c)).alias(c) for c in ENRICHED]
    return rows.select(*keep, "rsi", "trend", "extreme_point", "psar_step", *gated)


# -- history and live records ------------------------------------------------------

UNION_ORDER = ("src_seq", "trade_date")


def history_live_union(history: DataFrame, live: DataFrame) -> DataFrame:
    """Preloaded rows (``src_seq`` 0) before live rows (1); overlaps are kept."""
    return history.withColumn("src_seq", F.lit(0)).unionByName(
        live.withColumn("src_seq", F.lit(1))
    )


def history_live_dedup(
    history: DataFrame, live: DataFrame, key: tuple[str, ...] = ("ts_code", "trade_date")
) -> DataFrame:
    """One row per bar key, the live one where both exist.

    Of repeats within one part the largest stays, column by column, so the winner does
    not depend on the order of the rows. An aggregate, so repeats shrink before the shuffle.
    """
    union = history_live_union(history, live)
    rest = ["src_seq", *(c for c in union.columns if c not in {*key, "src_seq"})]
    newest = union.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_newest"))
    return newest.select(*key, "_newest.*").select(*union.columns)


# -- quality measures (own definitions) ------------------------------------------


def kdj_hit_rate(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Per series: how often sign(K - D) matched the sign of the next close change."""
    window = layout.window()
    # A row needs K and D of the row before it, hence one more row of look-back.
    rows = with_context(bars, I.KDJ_PERIOD, layout)
    rows = I.add_kdj(rows, layout).withColumn("_at", position(layout))
    rows = rows.withColumns(
        {
            "_lead": F.signum(F.lag(F.col("k") - F.col("d")).over(window)),
            "_move": F.signum(F.col("close") - F.lag("close").over(window)),
        }
    )
    scored = (F.col("_at") - 1 > WARMUP) & F.col("_lead").isNotNull() & F.col("_move").isNotNull()
    hit = scored & (F.col("_lead") == F.col("_move"))
    return (
        without_context(rows)
        .groupBy(layout.key)
        .agg(F.count_if(scored).alias("n_scored"), F.count_if(hit).alias("n_hit"))
        .withColumn("hit_rate", F.try_divide("n_hit", "n_scored"))
    )


def obv_close_corr(bars: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Per series: correlation of cumulative volume with the close."""
    rows = without_context(I.add_obv(with_context(bars, 1, layout), layout))
    return rows.groupBy(layout.key).agg(F.corr("obv", "close").alias("obv_close_corr"))
