"""The indicators as SQL functions of a session.

Scalar functions take an ordered array of what an indicator looks back on, so SQL's own
frames and groups decide how far that is:

    SELECT ts_code, trade_date,
           rsi_of(collect_list(struct(high, low, close)) OVER (
                      PARTITION BY ts_code ORDER BY trade_date
                      ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 14)
    FROM bars

Table functions give the whole-series results of a registered bar view. All are SQL over
built-in functions; no Python runs.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from candlewick.functions.stop_and_reverse import AF_MAX, AF_STEP
from candlewick.functions.tails import KD_START, KDJ_PERIOD

_BARS = "ARRAY<STRUCT<high: DOUBLE, low: DOUBLE, close: DOUBLE>>"
_KD = "STRUCT<k: DOUBLE, d: DOUBLE>"

# A subquery in a function is put in wherever its columns are used, and so computed as often.
# What is used twice is therefore a lambda's variable.

# Range positions of every frame of `period` bars; null where a high or low of it is missing.
_POSITIONS = """
transform(sequence(period, size(bars)), last -> transform(array(slice(bars, last - period + 1, period)), f ->
  CASE WHEN exists(f.high, x -> x IS NULL) OR exists(f.low, x -> x IS NULL) THEN NULL
       ELSE transform(array(struct(f[period - 1].close AS close, array_max(f.high) AS high, array_min(f.low) AS low)), r ->
         CASE WHEN r.close IS NULL THEN NULL WHEN r.high = r.low THEN 50D
              ELSE (r.close - r.low) / (r.high - r.low) * 100D END)[0] END)[0])"""

SCALARS = {
    "rsi_of": f"""(bars {_BARS}, period INT DEFAULT 14) RETURNS DOUBLE
COMMENT 'RSI after the last bar; the first of a series has no change. Needs period + 2 bars, or all of a shorter series.'
RETURN transform(
  array(zip_with(slice(bars.close, greatest(size(bars) - period, 2), period + 1),
                 slice(bars.close, greatest(size(bars) - period, 2) - 1, period + 1), (x, y) -> x - y)),
  moves -> 100D - 100D / (1D + try_divide(aggregate(moves, 0D, (a, m) -> a + greatest(m, 0D)),
                                          aggregate(moves, 0D, (a, m) -> a - least(m, 0D)))))[0]""",
    "kdj_of": f"""(bars {_BARS}, period INT DEFAULT {KDJ_PERIOD}) RETURNS STRUCT<k: DOUBLE, d: DOUBLE, j: DOUBLE>
COMMENT 'K, D and J after the last bar, smoothed over every frame of period bars in the array.'
RETURN CASE WHEN size(bars) >= period THEN
  aggregate({_POSITIONS}, CAST(named_struct('k', {KD_START}D, 'd', {KD_START}D) AS {_KD}), (a, x) ->
    CAST(named_struct('k', 2D / 3D * a.k + 1D / 3D * x,
                      'd', 2D / 3D * a.d + 1D / 3D * (2D / 3D * a.k + 1D / 3D * x)) AS {_KD}),
    kd -> named_struct('k', kd.k, 'd', kd.d, 'j', 3D * kd.k - 2D * kd.d)) END""",
    "psar_of": f"""(bars {_BARS}, af_step DOUBLE DEFAULT {AF_STEP}D, af_max DOUBLE DEFAULT {AF_MAX}D) RETURNS DOUBLE
COMMENT 'Stop-and-reverse level after the last bar, started at the first.'
RETURN CASE WHEN size(bars) > 0 AND NOT exists(bars, b -> b.high IS NULL OR b.low IS NULL) THEN
  aggregate(slice(bars, 2, size(bars)),
    named_struct('p', bars[0].close, 't', 1, 'ep', bars[0].high, 'af', af_step), (s, b) ->
    CASE
      WHEN s.t = 1 THEN CASE
        WHEN b.low < s.p + (s.ep - s.p) * s.af THEN named_struct('p', s.ep, 't', -1, 'ep', b.low, 'af', af_step)
        WHEN b.high > s.ep THEN
          named_struct('p', s.p + (s.ep - s.p) * s.af, 't', 1, 'ep', b.high, 'af', least(s.af + af_step, af_max))
        ELSE named_struct('p', s.p + (s.ep - s.p) * s.af, 't', 1, 'ep', s.ep, 'af', s.af) END
      WHEN b.high > s.p + (s.ep - s.p) * s.af THEN named_struct('p', s.ep, 't', 1, 'ep', b.high, 'af', af_step)
      WHEN b.low < s.ep THEN
        named_struct('p', s.p + (s.ep - s.p) * s.af, 't', -1, 'ep', b.low, 'af', least(s.af + af_step, af_max))
      ELSE named_struct('p', s.p + (s.ep - s.p) * s.af, 't', -1, 'ep', s.ep, 'af', s.af) END,
    s -> s.p) END""",
    "obv_of": """(volumes ARRAY<DOUBLE>) RETURNS DOUBLE
COMMENT 'Cumulative volume; a missing one counts as 0.'
RETURN aggregate(volumes, 0D, (a, v) -> a + coalesce(v, 0D))""",
}

_SERIES = """
  SELECT ts_code, transform(sort_array(collect_list(struct(trade_date, high, low, close))),
                            b -> struct(b.high, b.low, b.close)) AS bars
  FROM {view} GROUP BY ts_code"""

TABLES = {
    "kdj_by_series": f"""(period INT DEFAULT {KDJ_PERIOD}) RETURNS TABLE (ts_code STRING, n_bars BIGINT, k DOUBLE, d DOUBLE, j DOUBLE)
RETURN SELECT ts_code, size(bars), kdj.k, kdj.d, kdj.j
FROM (SELECT ts_code, bars, kdj_of(bars, kdj_by_series.period) AS kdj FROM ({_SERIES}))""",
    "psar_by_series": f"""(af_step DOUBLE DEFAULT {AF_STEP}D, af_max DOUBLE DEFAULT {AF_MAX}D) RETURNS TABLE (ts_code STRING, psar DOUBLE)
RETURN SELECT ts_code, psar_of(bars, psar_by_series.af_step, psar_by_series.af_max) FROM ({_SERIES})""",
    "obv_by_series": """() RETURNS TABLE (ts_code STRING, obv DOUBLE)
RETURN SELECT ts_code, coalesce(sum(vol), 0D) FROM {view} GROUP BY ts_code""",
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def register(spark: SparkSession, view: str | None = None) -> list[str]:
    """Define the scalar functions in the session, and for a bar table or view the table
    functions; returns their names.

    A scalar function sees its array only: frames keep that short. The table functions hold
    a series as one array; for series of millions of bars use the DataFrame forms in
    `operators.aggregates`, which cut them.
    """
    made = dict(SCALARS)
    if view is not None:
        if not _NAME.fullmatch(view):
            raise ValueError(f"not a table name: {view}")
        made |= {name: text.format(view=view) for name, text in TABLES.items()}
    for name, text in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
    return list(made)
