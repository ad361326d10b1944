"""Reference SQL (DuckDB) for the registered queries, written independently of them.

Each string runs on the same parquet tables.  Doubles are rounded to six places on
both sides; `+ 0.0` turns a rounded negative zero into zero.
"""

from __future__ import annotations

from candlewick import queries as Q

BAR_DOUBLES = (
    "open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount",
)


def r6(*columns: str) -> str:
    return ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in columns)


DAILY_RAW = """
raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ts_code,
         strftime(l_shipdate, '%Y%m%d') AS trade_date,
         first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(l_extendedprice) AS high,
         min(l_extendedprice) AS low,
         last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         sum(l_quantity) AS vol,
         round(sum(l_extendedprice), 2) AS amount
  FROM lineitem GROUP BY 1, 2)"""

HOURLY_RAW = """
raw AS (
  SELECT event_type AS ts_code,
         strftime(ts, '%Y%m%d%H') AS trade_date,
         first(value ORDER BY ts, event_id) AS open,
         max(value) AS high,
         min(value) AS low,
         last(value ORDER BY ts, event_id) AS close,
         CAST(count(*) AS DOUBLE) AS vol,
         round(sum(value), 2) AS amount
  FROM events GROUP BY 1, 2)"""

BARS = """,
bars AS (
  SELECT *, close - pre_close AS change, (close - pre_close) / pre_close * 100 AS pct_chg
  FROM (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close,
               row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS n
        FROM raw))"""

DAILY = DAILY_RAW + BARS
HOURLY = HOURLY_RAW + BARS

MOVES = """,
deltas AS (
  SELECT *, close - lag(close) OVER (PARTITION BY ts_code ORDER BY n) AS delta FROM bars),
moves AS (
  SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0.0::DOUBLE END AS gain,
            CASE WHEN delta < 0 THEN -delta ELSE 0.0::DOUBLE END AS loss FROM deltas),
means AS (
  SELECT *, avg(gain) OVER w AS avg_gain, avg(loss) OVER w AS avg_loss FROM moves
  WINDOW w AS (PARTITION BY ts_code ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
strength AS (
  SELECT *, CASE WHEN avg_loss = 0 THEN NULL ELSE avg_gain / avg_loss END AS rs FROM means),
rsi AS (SELECT *, 100 - 100 / (1 + rs) AS rsi FROM strength)"""

STEP = """,
starts AS (
  SELECT *, first_value(close) OVER (PARTITION BY ts_code ORDER BY n) AS p0 FROM bars),
trends AS (
  SELECT *, CASE WHEN close > p0 THEN 1 ELSE -1 END AS trend FROM starts),
step AS (
  SELECT ts_code, n, trade_date, high, low, close, trend,
         CASE WHEN trend = 1 THEN high ELSE low END AS extreme_point,
         p0 + (CASE WHEN trend = 1 THEN high ELSE low END - p0) * 0.02::DOUBLE AS psar
  FROM trends)"""

KDJ = """,
frames AS (
  SELECT *, max(high) OVER w AS hh, min(low) OVER w AS ll, count(high) OVER w AS hs,
         count(low) OVER w AS ls FROM bars
  WINDOW w AS (PARTITION BY ts_code ORDER BY n ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
rsvs AS (
  SELECT *, CASE WHEN hs < 9 OR ls < 9 OR close IS NULL THEN NULL WHEN hh = ll THEN 50.0::DOUBLE
                 ELSE (close - ll) / (hh - ll) * 100 END AS rsv FROM frames),
ks AS (SELECT *, 2.0::DOUBLE / 3 * 50 + 1.0::DOUBLE / 3 * rsv AS k FROM rsvs),
ds AS (SELECT *, 2.0::DOUBLE / 3 * 50 + 1.0::DOUBLE / 3 * k AS d FROM ks),
kdj AS (SELECT *, 3 * k - 2 * d AS j FROM ds)"""

_NEXT_STATE = """
  SELECT ts_code, n, i + 1,
         CASE WHEN crossed THEN ep ELSE moved END,
         CASE WHEN crossed THEN -t ELSE t END,
         CASE WHEN crossed THEN CASE WHEN t = 1 THEN low ELSE high END
              WHEN extended THEN CASE WHEN t = 1 THEN high ELSE low END ELSE ep END,
         CASE WHEN crossed THEN 0.02::DOUBLE
              WHEN extended THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END
  FROM (SELECT *, CASE WHEN t = 1 THEN low < moved ELSE high > moved END AS crossed,
                  CASE WHEN t = 1 THEN high > ep ELSE low < ep END AS extended
        FROM (SELECT s.*, b.high, b.low, s.p + s.af * (s.ep - s.p) AS moved
              FROM {name} s JOIN bars b ON b.ts_code = s.ts_code AND b.n = s.i + 1
              WHERE s.i < s.n))"""

# Restart at every row over its last ten rows.
ROLLING_PSAR = """,
rolling(ts_code, n, i, p, t, ep, af) AS (
  SELECT b.ts_code, b.n, f.n, f.close, 1, f.high, 0.02::DOUBLE
  FROM bars b JOIN bars f ON f.ts_code = b.ts_code AND f.n = greatest(b.n - 9, 1)
  UNION ALL""" + _NEXT_STATE.format(name="rolling") + """),
sar AS (SELECT ts_code, n, p AS psar FROM rolling WHERE i = n)"""

SERIES_PSAR = """,
lengths AS (SELECT ts_code, max(n) AS n FROM bars GROUP BY 1),
whole(ts_code, n, i, p, t, ep, af) AS (
  SELECT l.ts_code, l.n, b.n, b.close, 1, b.high, 0.02::DOUBLE
  FROM lengths l JOIN bars b ON b.ts_code = l.ts_code AND b.n = 1
  UNION ALL""" + _NEXT_STATE.format(name="whole") + """)"""

SERIES_KDJ = """,
folded(ts_code, n, k, d) AS (
  SELECT ts_code, 8::BIGINT, 50.0::DOUBLE, 50.0::DOUBLE FROM rsvs WHERE n = 9
  UNION ALL
  SELECT f.ts_code, x.n, 2.0::DOUBLE / 3 * f.k + x.rsv / 3,
         2.0::DOUBLE / 3 * f.d + (2.0::DOUBLE / 3 * f.k + x.rsv / 3) / 3
  FROM folded f JOIN rsvs x ON x.ts_code = f.ts_code AND x.n = f.n + 1),
ends AS (SELECT ts_code, max(n) AS n_bars FROM bars GROUP BY 1)"""

# Bar by bar: both averages from the first close, the signal from their first difference.
MACD = """,
averaged(ts_code, n, f, s, g) AS (
  SELECT ts_code, n, close, close, 0.0::DOUBLE FROM bars WHERE n = 1
  UNION ALL
  SELECT a.ts_code, b.n, a.f + 2.0::DOUBLE / 13 * (b.close - a.f), a.s + 2.0::DOUBLE / 27 * (b.close - a.s),
         a.g + 0.2::DOUBLE * (a.f + 2.0::DOUBLE / 13 * (b.close - a.f) - a.s - 2.0::DOUBLE / 27 * (b.close - a.s) - a.g)
  FROM averaged a JOIN bars b ON b.ts_code = a.ts_code AND b.n = a.n + 1)"""

ENRICHED = KDJ + ROLLING_PSAR + """,
enriched AS (
  SELECT b.* EXCLUDE (k, d, j),
         CASE WHEN b.n > 14 THEN b.k END AS k,
         CASE WHEN b.n > 14 THEN b.d END AS d,
         CASE WHEN b.n > 14 THEN b.j END AS j,
         CASE WHEN b.n > 14 THEN sum(b.vol) OVER (PARTITION BY b.ts_code ORDER BY b.n) END AS obv,
         CASE WHEN b.n > 14 THEN s.psar END AS psar
  FROM kdj b JOIN sar s ON s.ts_code = b.ts_code AND s.n = b.n)"""

INDICATOR_ROWS = f"""
SELECT ts_code, trade_date, {r6("close", "rsi", "psar")}
FROM (SELECT r.ts_code, r.trade_date, r.close, r.rsi, s.psar
      FROM rsi r JOIN step s ON s.ts_code = r.ts_code AND s.n = r.n)"""

ENRICHED_FIVE = f"""
SELECT ts_code, trade_date, {r6("k", "d", "j", "obv", "psar")} FROM enriched"""

FULL_BAR = f"SELECT ts_code, trade_date, {r6(*BAR_DOUBLES)} FROM bars"

# The messages of the partial-message queries, as rows.
PARTIAL = DAILY + """,
partial AS (
  SELECT ts_code,
         CASE WHEN vol % 7 <> 5 THEN trade_date END AS trade_date,
         CASE WHEN vol % 7 <> 1 THEN high END AS high,
         CASE WHEN vol % 7 <> 2 THEN low END AS low,
         CASE WHEN vol % 7 <> 3 THEN close END AS close,
         CASE WHEN vol % 7 IN (0, 1, 4) THEN vol END AS vol,
         CASE WHEN vol % 7 IN (2, 4, 5) THEN vol + 0.5 END AS volume
  FROM bars)"""

UNION = f""",
joined AS (
  SELECT 0 AS src_seq, ts_code, trade_date, close, high, low, vol FROM bars
  WHERE trade_date <= '{Q.HISTORY_END}'
  UNION ALL
  SELECT 1, ts_code, trade_date, close, high, low, vol FROM bars
  WHERE trade_date >= '{Q.LIVE_START}')"""

# The union as a bar table of its own, for the queries that enrich it.
UNION_BARS = UNION.replace("FROM bars", "FROM daily_bars") + """,
bars AS (
  SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY src_seq, trade_date) AS n
  FROM joined)"""
WARM = DAILY.replace("bars AS", "daily_bars AS") + UNION_BARS + ENRICHED

# Bars in order of arrival (see `queries.arrival`), for the paced streams.


def _arrival(cuts: tuple[str, ...]) -> str:
    by_date = " + ".join(f"CAST(trade_date > '{cut}' AS INT)" for cut in cuts)
    return f"{by_date} + CAST(vol % 5 = 0 AS INT)"


PACED = DAILY.replace("bars AS", "daily_bars AS") + f""",
bars AS (
  SELECT * EXCLUDE (n),
         row_number() OVER (PARTITION BY ts_code ORDER BY {_arrival(Q.PACE_CUTS)}, trade_date) AS n
  FROM daily_bars)""" + ENRICHED
WARM_PACED = WARM.replace(
    "ORDER BY src_seq, trade_date",
    f"ORDER BY src_seq, CASE WHEN src_seq = 1 THEN {_arrival(Q.WARM_PACE_CUTS)} ELSE 0 END, trade_date",
)

# Two micro-batches as series of their own.
BATCHED = DAILY.replace("bars AS", "daily_bars AS") + f""",
bars AS (
  SELECT * EXCLUDE (ts_code),
         ts_code || '#' || CAST(trade_date > '{Q.STREAM_CUT}' AS INT) AS ts_code
  FROM daily_bars)""" + MOVES + STEP


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


ORACLE_SQL: dict[str, str] = {
    "bars_daily": sql(DAILY, FULL_BAR),
    "bars_hourly": sql(HOURLY, FULL_BAR),
    "bars_scan": sql(
        DAILY, f"{FULL_BAR} WHERE trade_date BETWEEN '{Q.SCAN_START}' AND '{Q.SCAN_END}'"
    ),
    "bars_scan_code": sql(
        DAILY,
        f"""{FULL_BAR} WHERE ts_code = '{Q.SCAN_CODE}'
        AND trade_date BETWEEN '{Q.SCAN_START}' AND '{Q.SCAN_END}'""",
    ),
    "bars_on_date": sql(
        DAILY,
        f"""SELECT ts_code, trade_date, {r6("close", "high", "low", "vol")} FROM bars
        WHERE trade_date = '{Q.SCAN_DAY}'""",
    ),
    "bars_page": sql(
        DAILY,
        f"{FULL_BAR} ORDER BY ts_code, trade_date LIMIT {Q.PAGE_LIMIT} OFFSET {Q.PAGE_OFFSET}",
    ),
    "history_scan": sql(
        DAILY,
        f"""SELECT ts_code, trade_date, {r6("close", "high", "low")}, round(vol, 6) + 0.0 AS volume
        FROM bars WHERE trade_date >= '{Q.LIVE_START}'""",
    ),
    "required_fields": sql(
        PARTIAL,
        f"""SELECT ts_code, coalesce(trade_date, '') AS trade_date, {r6("high", "low", "close")}
        FROM partial WHERE high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
    ),
    "volume_alias": sql(
        PARTIAL,
        """SELECT ts_code, coalesce(trade_date, '') AS trade_date,
        round(coalesce(vol, volume, 0.0), 6) + 0.0 AS volume FROM partial""",
    ),
    "json_roundtrip": sql(DAILY, FULL_BAR),
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "bar_counts": sql(DAILY, "SELECT ts_code, count(*) AS n_bars FROM bars GROUP BY 1"),
    "first_close": sql(
        DAILY, "SELECT ts_code, round(close, 6) + 0.0 AS first_close FROM bars WHERE n = 1"
    ),
    "obv_total": sql(
        DAILY,
        """SELECT ts_code, bool_or(vol IS NOT NULL) AS has_volume,
        round(coalesce(sum(vol), 0), 6) + 0.0 AS obv FROM bars GROUP BY 1""",
    ),
    "price_delta": sql(
        DAILY + MOVES, f"SELECT ts_code, trade_date, {r6('close', 'delta')} FROM deltas"
    ),
    "avg_gain_loss": sql(
        DAILY + MOVES,
        f"""SELECT ts_code, trade_date,
        {r6("close", "delta", "gain", "loss", "avg_gain", "avg_loss")} FROM means""",
    ),
    "rolling_extremes": sql(
        DAILY + KDJ,
        f"""SELECT ts_code, trade_date, {r6("high", "low")}, round(hh, 6) + 0.0 AS highest,
        round(ll, 6) + 0.0 AS lowest FROM frames""",
    ),
    "obv_running": sql(
        DAILY,
        """SELECT ts_code, trade_date, round(vol, 6) + 0.0 AS vol,
        round(sum(vol) OVER (PARTITION BY ts_code ORDER BY n), 6) + 0.0 AS obv FROM bars""",
    ),
    "last_k_bars": sql(
        DAILY,
        f"""SELECT ts_code, trade_date, {r6("close", "high", "low", "vol")}
        FROM (SELECT *, max(n) OVER (PARTITION BY ts_code) - n AS age FROM bars)
        WHERE age < {Q.LAST_K}""",
    ),
    "rsi": sql(
        DAILY + MOVES,
        f"""SELECT ts_code, trade_date,
        {r6("close", "delta", "gain", "loss", "avg_gain", "avg_loss", "rs", "rsi")} FROM rsi""",
    ),
    "psar_step": sql(
        DAILY + STEP,
        f"""SELECT ts_code, trade_date, trend,
        {r6("high", "low", "close", "extreme_point", "psar")} FROM step""",
    ),
    "kdj_window": sql(
        DAILY + KDJ,
        f"SELECT ts_code, trade_date, {r6('high', 'low', 'close', 'k', 'd', 'j')} FROM kdj",
    ),
    "psar_window": sql(
        DAILY + ROLLING_PSAR,
        f"""SELECT ts_code, trade_date, {r6("high", "low", "close", "psar")}
        FROM bars JOIN sar USING (ts_code, n)""",
    ),
    "kdj_agg": sql(
        DAILY + KDJ + SERIES_KDJ,
        f"""SELECT ts_code, n_bars, {r6("k", "d", "j")}
        FROM (SELECT e.ts_code, e.n_bars, f.k, f.d, 3 * f.k - 2 * f.d AS j FROM ends e
              LEFT JOIN folded f ON f.ts_code = e.ts_code AND f.n = e.n_bars)""",
    ),
    "psar_agg": sql(
        DAILY + SERIES_PSAR,
        "SELECT ts_code, round(p, 6) + 0.0 AS psar FROM whole WHERE i = n",
    ),
    "indicator_rows": sql(DAILY + MOVES + STEP, INDICATOR_ROWS),
    "indicator_join": sql(DAILY + MOVES + STEP, INDICATOR_ROWS),
    "enriched_records": sql(
        DAILY + ENRICHED,
        f"""SELECT ts_code, trade_date, {r6(*BAR_DOUBLES, "k", "d", "j", "obv", "psar")}
        FROM enriched""",
    ),
    "all_indicators": sql(
        DAILY + MOVES + STEP + ENRICHED,
        f"""SELECT ts_code, trade_date, trend,
        {r6("close", "high", "low", "vol", "rsi", "extreme_point", "psar_step",
            "k", "d", "j", "obv", "psar")}
        FROM (SELECT e.*, r.rsi, s.trend, s.extreme_point, s.psar AS psar_step FROM enriched e
              JOIN rsi r ON r.ts_code = e.ts_code AND r.n = e.n
              JOIN step s ON s.ts_code = e.ts_code AND s.n = e.n)""",
    ),
    "indicator_rows_hourly": sql(HOURLY + MOVES + STEP, INDICATOR_ROWS),
    "history_live_union": sql(
        DAILY + UNION,
        f"""SELECT ts_code, trade_date, src_seq, {r6("close", "high", "low", "vol", "obv")}
        FROM (SELECT *, sum(vol) OVER (PARTITION BY ts_code ORDER BY src_seq, trade_date) AS obv
              FROM joined)""",
    ),
    "history_live_dedup": sql(
        DAILY + UNION,
        f"""SELECT ts_code, trade_date, src_seq, {r6("close", "high", "low", "vol")}
        FROM (SELECT *, max(src_seq) OVER (PARTITION BY ts_code, trade_date) AS best FROM joined)
        WHERE src_seq = best""",
    ),
    "latest_panel": sql(
        DAILY + ENRICHED,
        f"""SELECT ts_code, trade_date, {r6("k", "d", "j", "obv", "psar")}
        FROM (SELECT *, max(n) OVER (PARTITION BY ts_code) AS last FROM enriched) WHERE n = last""",
    ),
    "latest_panel_text": sql(
        DAILY + ENRICHED,
        "SELECT ts_code, trade_date, "
        + ", ".join(
            f"""CASE WHEN round({c}, 6) <> 0 THEN printf('%.2f', round({c}, 6)) ELSE '--' END AS {c}"""
            for c in ("k", "d", "j", "obv", "psar")
        )
        + """ FROM (SELECT *, max(n) OVER (PARTITION BY ts_code) AS last FROM enriched)
        WHERE n = last""",
    ),
    "chart_series": sql(
        DAILY + ENRICHED,
        " UNION ALL ".join(
            f"""SELECT ts_code, trade_date AS x, '{chart}' AS chart, '{name}' AS series,
            round({column}, 6) + 0.0 AS y FROM enriched"""
            for chart, name, column in (
                ("price", "close", "close"), ("kdj", "K", "k"), ("kdj", "D", "d"),
                ("kdj", "J", "j"), ("obv", "OBV", "obv"), ("psar", "close", "close"),
                ("psar", "PSAR", "psar"),
            )
        ),
    ),
    "history_lookup": sql(
        DAILY + ENRICHED,
        f"""SELECT ts_code, trade_date, {r6("close", "k", "d", "j", "obv", "psar")} FROM enriched
        WHERE trade_date BETWEEN '{Q.SCAN_START}' AND '{Q.SCAN_END}'""",
    ),
    "kdj_hit_rate": sql(
        DAILY + KDJ,
        """SELECT ts_code, count(*) FILTER (scored) AS n_scored,
        count(*) FILTER (scored AND lead = move) AS n_hit,
        round(CASE WHEN count(*) FILTER (scored) > 0 THEN count(*) FILTER (scored AND lead = move)
              / count(*) FILTER (scored)::DOUBLE END, 6) + 0.0 AS hit_rate
        FROM (SELECT *, n > 14 AND lead IS NOT NULL AND move IS NOT NULL AS scored
              FROM (SELECT ts_code, n, sign(k - d) AS lead,
                    sign(lead(close) OVER (PARTITION BY ts_code ORDER BY n) - close) AS move
                    FROM kdj))
        GROUP BY 1""",
    ),
    "obv_close_corr": sql(
        DAILY,
        """SELECT ts_code, round(corr(obv, close), 6) + 0.0 AS obv_close_corr
        FROM (SELECT ts_code, close, sum(vol) OVER (PARTITION BY ts_code ORDER BY n) AS obv
              FROM bars) GROUP BY 1""",
    ),
    "stream_warm_start": sql(WARM, ENRICHED_FIVE + " WHERE src_seq = 1"),
}
_SAME = {
    "stream_decode": "bars_daily",
    "stream_warm_start_store": "stream_warm_start",
}
ORACLE_SQL.update({name: ORACLE_SQL[other] for name, other in _SAME.items()})
ORACLE_SQL["stream_enriched_paced"] = sql(PACED, ENRICHED_FIVE)
ORACLE_SQL["stream_warm_start_paced"] = sql(WARM_PACED, ENRICHED_FIVE + " WHERE src_seq = 1")
ORACLE_SQL["stream_batch_indicators"] = sql(
    BATCHED, INDICATOR_ROWS.replace("r.ts_code, r.trade_date", "split_part(r.ts_code, '#', 1) AS ts_code, r.trade_date")
)
ORACLE_SQL["stream_enriched"] = sql(DAILY + ENRICHED, ENRICHED_FIVE)
ORACLE_SQL["macd"] = sql(
    DAILY + MACD,
    """SELECT ts_code, trade_date, round(close, 6) + 0.0 AS close, round(f - s, 2) + 0.0 AS macd,
    round(g, 2) + 0.0 AS signal, round(f - s - g, 2) + 0.0 AS histogram
    FROM bars JOIN averaged USING (ts_code, n)""",
)
ORACLE_SQL["stream_dedup"] = sql(
    DAILY, f"SELECT ts_code, trade_date, {r6('close', 'high', 'low', 'vol')} FROM bars"
)
ORACLE_SQL["stream_rejects"] = sql(
    DAILY,
    """SELECT CASE WHEN vol % 7 <> 6 THEN ts_code END AS ts_code,
    CASE WHEN vol % 7 <> 6 THEN trade_date END AS trade_date,
    CASE vol % 7 WHEN 6 THEN 'unreadable' WHEN 1 THEN 'without high' WHEN 2 THEN 'without low'
                 WHEN 3 THEN 'without close' ELSE 'accepted' END AS reason FROM bars""",
)
ORACLE_SQL["stream_replay"] = sql(
    DAILY,
    f"""SELECT ts_code, trade_date, {r6("close", "high", "low", "vol")},
    row_number() OVER (ORDER BY trade_date, ts_code) - 1 AS at FROM bars""",
)
ORACLE_SQL["history_upsert"] = sql(
    DAILY,
    f"""SELECT ts_code, trade_date, {r6("close", "high", "low")},
    round(vol + CAST(trade_date >= '{Q.LIVE_START}' AS INT), 6) + 0.0 AS vol FROM bars""",
)
ORACLE_SQL["sql_indicators"] = sql(
    DAILY + MOVES + KDJ + ROLLING_PSAR,
    f"""SELECT ts_code, trade_date, {r6("rsi", "k", "d", "j", "psar")}
    FROM (SELECT k.ts_code, k.trade_date, r.rsi, k.k, k.d, k.j, s.psar FROM kdj k
          JOIN rsi r USING (ts_code, n) JOIN sar s USING (ts_code, n))""",
)
ORACLE_SQL["sql_series"] = sql(
    DAILY + KDJ + SERIES_KDJ + SERIES_PSAR,
    f"""SELECT ts_code, n_bars, {r6("k", "d", "j", "psar", "obv")}
    FROM (SELECT e.ts_code, e.n_bars, f.k, f.d, 3 * f.k - 2 * f.d AS j, w.p AS psar, v.obv FROM ends e
          JOIN whole w ON w.ts_code = e.ts_code AND w.i = w.n
          JOIN (SELECT ts_code, sum(vol) AS obv FROM bars GROUP BY 1) v ON v.ts_code = e.ts_code
          LEFT JOIN folded f ON f.ts_code = e.ts_code AND f.n = e.n_bars)""",
)
for _name in ("enriched_records", "kdj_agg", "psar_agg", "macd"):
    ORACLE_SQL[f"{_name}_hourly"] = ORACLE_SQL[_name].replace(DAILY_RAW, HOURLY_RAW)
