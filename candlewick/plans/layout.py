"""How a bar series is laid out over tasks before windows run on it.

Every indicator is a window over one series (one ``ts_code``) in date order.
Partitioning by the series alone puts a whole series into one task, which is
fine while a series is short and fatal when one series holds a third of all
rows.  ``SeriesLayout`` therefore cuts each series into calendar chunks (a
prefix of the ordering string) and ``with_context`` hands every chunk what its
first rows need from earlier chunks: the last ``lookback`` rows as *halo* rows,
and the totals before the chunk.  All windows then run per (series, chunk) and
give the same values as one window over the whole series.

The frames used by the indicators reach back 15 rows at most, so the halo is a
small, fixed number of rows per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HALO = "_halo"
CHUNK = "_chunk"
N_INC = "_n_inc"
VOL_INC = "_vol_inc"
FIRST_CLOSE = "_first_close"
CONTEXT_COLUMNS = (HALO, CHUNK, N_INC, VOL_INC, FIRST_CLOSE)


@dataclass(frozen=True)
class SeriesLayout:
    """Key, order and chunking of a set of series.

    ``chunk_chars`` is the length of the ``trade_date`` prefix that names a
    chunk: 4 cuts daily bars into years, 6 cuts hourly bars into months, 8 cuts
    minute bars into days.  ``None`` keeps each series whole.
    ``order`` may start with columns that rank above the date; they become part
    of the chunk name so that chunks stay in series order.
    """

    key: str = "ts_code"
    order: tuple[str, ...] = ("trade_date",)
    chunk_chars: int | None = 4

    def whole(self) -> SeriesLayout:
        return replace(self, chunk_chars=None)

    def chunk(self) -> Column:
        date_at = self.order.index("trade_date")
        parts = [F.col(c) for c in self.order[:date_at]]
        # Rows without a date come first, in a chunk of their own.
        prefix = F.coalesce(F.substring("trade_date", 1, self.chunk_chars), F.lit(""))
        parts.append(prefix.alias("prefix"))
        return F.struct(*parts) if len(parts) > 1 else parts[0]

    @property
    def task_keys(self) -> list[str]:
        """What the rows of one window share."""
        return [self.key] if self.chunk_chars is None else [self.key, CHUNK]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.task_keys).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


# Bars built by the daily adapter are unique per (series, day): 366 rows a year at
# most, however many raw rows a series has.  Such a series is small enough for one
# task, so it is kept whole and costs one exchange and one sort.
DAILY = SeriesLayout(chunk_chars=None)
# Hourly bars of few series: ten-day chunks (240 rows) give every core work.
HOURLY = SeriesLayout(chunk_chars=7)


def with_context(bars: DataFrame, lookback: int, layout: SeriesLayout) -> DataFrame:
    """Bars plus the halo rows and running increments their windows need.

    Adds ``_halo`` (row belongs to an earlier chunk), ``_n_inc`` and
    ``_vol_inc`` (summed over ``layout.running()`` they give the position in
    the series and the volume so far) and ``_first_close`` (its first value in
    the chunk is the first close of the series).  Bars that bring increments of
    their own stand for more than one row each, as carried stream state does.
    """
    if layout.chunk_chars is None:
        return _first_hand(bars)
    # Both branches below read this one exchange.
    rows = bars.withColumn(CHUNK, layout.chunk()).repartition(layout.key, CHUNK)
    return _first_hand(rows).unionByName(_halo_rows(rows, lookback, layout))


def _first_hand(rows: DataFrame) -> DataFrame:
    n_inc, vol_inc = increments(rows)
    first_close = F.col("close") if "close" in rows.columns else F.lit(None).cast("double")
    return rows.withColumns(
        {HALO: F.lit(False), N_INC: n_inc, VOL_INC: vol_inc, FIRST_CLOSE: first_close}
    )


def increments(rows: DataFrame) -> tuple[Column, Column]:
    """How many rows and how much volume each row stands for."""
    if N_INC in rows.columns:
        return F.col(N_INC), F.col(VOL_INC)
    volumes = [F.col(c) for c in ("vol", "volume") if c in rows.columns]
    return F.lit(1).cast("long"), F.coalesce(*volumes, F.lit(0.0))


def without_context(rows: DataFrame) -> DataFrame:
    """Drop halo rows and the context columns once the windows are computed."""
    return rows.where(~F.col(HALO)).drop(*CONTEXT_COLUMNS)


def _halo_rows(rows: DataFrame, lookback: int, layout: SeriesLayout) -> DataFrame:
    key, order = layout.key, list(layout.order)
    payload = order + [c for c in rows.columns if c not in {key, *order, *CONTEXT_COLUMNS}]
    n_inc, vol_inc = increments(rows)
    first_close = F.first("close" if "close" in rows.columns else F.lit(None).cast("double"))
    chunk_wide = layout.window().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # Frames that end at the chunk's end would be summed anew for every row, so a
    # row's distance from the end is the chunk's size less its number.
    # At most `lookback` rows per chunk survive this filter.
    tails = (
        rows.withColumns(
            {
                "_at": F.row_number().over(layout.window()),
                "_size": F.count(F.lit(1)).over(chunk_wide),
                "_rows": F.sum(n_inc).over(chunk_wide),
                "_vol": F.sum(vol_inc).over(chunk_wide),
                "_first": first_close.over(chunk_wide),
            }
        )
        .where(F.col("_size") - F.col("_at") < lookback)
        .groupBy(key, CHUNK)
        .agg(
            F.first("_rows").alias("_rows"),
            F.first("_vol").alias("_vol"),
            F.first("_first").alias("_first"),
            F.collect_list(F.struct(*payload)).alias("_tail"),
        )
    )
    # One row per chunk from here on.  Every earlier chunk has at least one
    # row, so the `lookback` chunks before this one hold enough of them.
    by_chunk = Window.partitionBy(key).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    pool = F.sort_array(
        F.flatten(F.collect_list("_tail").over(by_chunk.rowsBetween(-lookback, -1)))
    )
    return (
        tails.select(
            key,
            CHUNK,
            F.sum("_rows").over(before).alias("_rows_before"),
            F.sum("_vol").over(before).alias("_vol_before"),
            F.first("_first").over(before).alias("_first_before"),
            pool.alias("_pool"),
        )
        .select(
            "*",
            F.posexplode(
                F.slice("_pool", F.greatest(F.size("_pool") - lookback + 1, F.lit(1)), lookback)
            ).alias("_pos", "_row"),
        )
        .repartition(key, CHUNK)
        .select(
            key,
            CHUNK,
            *[F.col(f"_row.{c}").alias(c) for c in payload],
            F.lit(True).alias(HALO),
            # The oldest halo row carries the totals before the chunk.
            F.when(F.col("_pos") == 0, F.col("_rows_before"))
            .otherwise(F.lit(0).cast("long"))
            .alias(N_INC),
            F.when(F.col("_pos") == 0, F.col("_vol_before")).otherwise(0.0).alias(VOL_INC),
            F.col("_first_before").alias(FIRST_CLOSE),
        )
    )
