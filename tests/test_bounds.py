"""Bounds, ranks, zones and ties of the sources; what a scan pushes down."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from fixtures import bars_of, golden_rows, near
from pyspark.sql import functions as F

from candlewick.operators import aggregates as A
from candlewick.operators import rows as R
from candlewick.plans.layout import DAILY, SeriesLayout
from candlewick.queries import NARROW, QUERIES
from candlewick.sources.bars import BAR_FIELDS, daily_bars, hourly_bars, scan_bars
from candlewick.sources.history import look_up, write_history
from conftest import SF_DIR

_LINES = (
    "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
    "l_quantity double, l_shipdate timestamp_ntz"
)


def lines(spark, *rows):
    """(order, line, price, day) of supplier 1."""
    full = [(o, n, 1, 1, price, 1.0, datetime(2001, 5, day, 13)) for o, n, price, day in rows]
    return spark.createDataFrame(full, _LINES)


def pushed(df) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)


def test_large_line_numbers_do_not_overtake_the_next_order(spark):
    bar = daily_bars(lines(spark, (1, 2001, 60.0, 1), (2, 0, 70.0, 1), (1, 1, 50.0, 1))).first()
    assert (bar.open, bar.close) == (50.0, 70.0)


def test_a_key_beyond_its_digits_fails_loudly(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        daily_bars(lines(spark, (1, 1_000_000, 60.0, 1))).collect()


def test_limit_zero_gives_no_rows(spark):
    bars = bars_of(spark, golden_rows())
    assert scan_bars(bars, limit=0).isEmpty()
    assert scan_bars(bars, limit=None, offset="").count() == 20
    assert scan_bars(bars, offset=18, limit=5).count() == 2


def test_undated_rows_are_found_before_any_end(spark, tmp_path):
    rows = golden_rows(count=3)
    rows[0]["trade_date"] = ""
    write_history(bars_of(spark, rows), str(tmp_path / "h"))
    folder = str(tmp_path / "h")
    assert look_up(spark, folder, end_date="20991231").count() == 3
    assert look_up(spark, folder, start_date="20250101").count() == 2


def test_undated_series_has_a_level_in_any_layout(spark):
    rows = golden_rows(count=2)
    for missing in (None, ""):
        for row in rows:
            row["trade_date"] = missing
        bars = bars_of(spark, rows)
        cut, whole = (A.psar_of_series(bars, x).first().psar for x in (SeriesLayout(), DAILY))
        assert cut is not None and cut == whole


def test_hours_do_not_depend_on_the_session_zone(spark):
    rows = [
        (1, datetime(2024, 3, 10, 2, 30), "a", 1.0),
        (2, datetime(2024, 3, 10, 3, 30), "a", 2.0),
        (3, datetime(2024, 3, 10, 2, 45), "a", 3.0),
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = hourly_bars(events).orderBy("trade_date").collect()
            assert [(r.trade_date, r.open, r.close) for r in got] == [
                ("2024031002", 1.0, 3.0),
                ("2024031003", 2.0, 2.0),
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bounds_keep_the_bars_of_an_unbounded_build(spark):
    table = lines(spark, *[(i, 1, 10.0 + i, 1 + i % 9) for i in range(40)])
    for fields in (BAR_FIELDS, NARROW):
        for start, end in (("20010503", "20010506"), (None, "20010502"), ("2001", "200105"), ("20010509", None)):
            got = daily_bars(table, ts_code="1", start_date=start, end_date=end, fields=fields)
            want = scan_bars(daily_bars(table), "1", start_date=start, end_date=end, fields=fields)
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_bounds_reach_the_scan(spark):
    for name, scans in (("history_scan", 1), ("history_live_union", 2), ("history_live_dedup", 2)):
        found = pushed(QUERIES[name](spark, SF_DIR))
        assert len(found) == scans and all("l_shipdate," in f and "Than" in f for f in found), name
    (found,) = pushed(QUERIES["bars_scan_code"](spark, SF_DIR))
    assert "EqualTo(l_suppkey,7)" in found and "LessThan(l_shipdate" in found


def test_repeats_within_one_part_have_one_winner(spark):
    history = bars_of(spark, golden_rows(count=1)).select(*NARROW)
    first, second = (history.withColumn("close", F.lit(c)) for c in (7.0, 9.0))
    for live in (first.unionByName(second), second.unionByName(first)):
        (row,) = R.history_live_dedup(history, live).collect()
        assert (row.src_seq, row.close) == (1, 9.0)


def test_parameters_change_the_look_back(spark):
    bars = bars_of(spark, golden_rows())
    options = dict(period=12, size=18, af_step=0.03, af_max=0.3)
    for transform in (R.enriched_records, R.all_indicators):
        whole = transform(bars, DAILY, **options).orderBy("trade_date").collect()
        cut = transform(bars, SeriesLayout(chunk_chars=8), **options).orderBy("trade_date").collect()
        assert all(near(a[c], b[c], 1e-12) for a, b in zip(whole, cut) for c in R.ENRICHED)
