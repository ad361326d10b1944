"""Flat, rising, short and gappy series; messages with faults; display text."""

from __future__ import annotations

from fixtures import bars_of, golden_rows, near, series
from pyspark.sql import Observation
from pyspark.sql import functions as F

from candlewick.functions.expressions import panel_text
from candlewick.operators import aggregates as A
from candlewick.operators import indicators as I
from candlewick.operators import rows as R
from candlewick.operators import views as V
from candlewick.plans.layout import DAILY
from candlewick.sources import messages as M
from candlewick.sources.bars import scan_bars, scan_history


def last(df):
    return df.orderBy(F.col("trade_date").desc()).first()


def test_flat(spark):
    bars = bars_of(spark, series("F", [(10.0, 10.0, 10.0, 1.0)] * 15))
    row = last(R.enriched_records(bars, DAILY))
    assert near(row.k, 50.0) and near(row.d, 50.0) and near(row.j, 50.0) and row.psar == 10.0
    assert I.rsi(bars, DAILY).where("rsi IS NOT NULL").isEmpty()


def test_rising(spark):
    bars = bars_of(
        spark, series("R", [(10 + i + 0.5, 10 + i - 0.5, 10.0 + i, 1.0) for i in range(15)])
    )
    row = last(R.enriched_records(bars, DAILY))
    assert near(row.k, 64.814815) and near(row.d, 54.938272) and near(row.j, 84.567901)
    assert near(row.psar, 18.990694)
    assert I.rsi(bars, DAILY).where("rsi IS NOT NULL").isEmpty()


def test_short_series(spark):
    bars = bars_of(spark, golden_rows(count=8))
    assert A.kdj_of_series(bars, DAILY).first().k is None
    assert A.psar_of_series(bars, DAILY).first().psar is not None
    assert V.latest_values(bars, DAILY).first().psar is None


def test_gate_opens_at_row_fifteen(spark):
    for count, filled in ((14, 0), (15, 1)):
        bars = bars_of(spark, golden_rows(count=count))
        assert R.enriched_records(bars, DAILY).where("obv IS NOT NULL").count() == filled


def test_null_high(spark):
    rows = golden_rows(count=15)
    rows[10]["high"] = None
    bars = bars_of(spark, rows)
    for row in (last(R.enriched_records(bars, DAILY)), V.latest_values(bars, DAILY).first()):
        assert row.k is None and row.d is None and row.j is None and row.psar is None
        assert row.obv == 25500.0
    assert A.kdj_of_series(bars, DAILY).first().k is None
    assert A.psar_of_series(bars, DAILY).first().psar is None


def test_missing_volume_counts_as_zero(spark):
    rows = golden_rows(count=15)
    rows[3]["vol"] = None
    assert last(R.enriched_records(bars_of(spark, rows), DAILY)).obv == 25500.0 - 1300.0
    none = A.volume_totals(bars_of(spark, [dict(r, vol=None) for r in rows]), DAILY).first()
    assert none.obv == 0.0 and not none.has_volume


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_volume_names_and_missing_date(spark):
    got = R.with_defaults(
        M.decode(
            messages(
                spark,
                '{"ts_code":"A","trade_date":"1","volume":5}',
                '{"ts_code":"B","trade_date":"1","vol":6,"volume":5}',
                '{"ts_code":"C","trade_date":"1"}',
                '{"ts_code":"D","vol":1}',
            )
        )
    )
    rows = {r.ts_code: r for r in got.collect()}
    assert [rows[c].volume for c in "ABCD"] == [5.0, 6.0, 0.0, 1.0]
    assert rows["D"].trade_date == "" and rows["A"].trade_date == "1"


def test_faulty_messages_are_dropped_and_counted(spark):
    good = '{"ts_code":"A","trade_date":"1","close":1.0,"high":2.0,"low":0.5}'
    arrived = messages(
        spark,
        good,
        "not json",
        '{"ts_code":"A","trade_date":"2","close":1.0,"high":2.0}',
        '{"ts_code":"A","trade_date":"3","close":NaN,"high":2.0,"low":0.5}',
    )
    read, kept = Observation("read"), Observation("kept")
    assert len(R.required_fields(M.decode(arrived, watch=read), watch=kept).collect()) == 1
    assert read.get == {"n_messages": 4, "n_unreadable": 1}
    assert kept.get == {"n_rejected": 2}
    as_bytes = arrived.select(F.col("value").cast("binary").alias("value"))
    assert R.required_fields(M.decode(as_bytes)).count() == 1


def test_encode_leaves_nulls_out(spark):
    text = M.encode(bars_of(spark, golden_rows(count=1)).select("ts_code", "pre_close")).first()
    assert text.value == '{"ts_code":"X"}'


def test_history_live_overlap(spark):
    bars = bars_of(spark, golden_rows()).select("ts_code", "trade_date", "close", "high", "low", "vol")
    history = scan_bars(bars, end_date="20250115", fields=tuple(bars.columns))
    live = scan_bars(bars, start_date="20250111", fields=tuple(bars.columns))
    union = R.history_live_union(history, live)
    assert union.count() == 25
    total = A.volume_totals(union, DAILY).first().obv
    assert total == 39000.0 + 2000 + 2100 + 2200 + 2300 + 2400
    single = R.history_live_dedup(history, live)
    assert single.count() == 20 and A.volume_totals(single, DAILY).first().obv == 39000.0
    assert single.where("trade_date = '20250112'").first().src_seq == 1


def test_panel_text(spark):
    values = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.0), (4, 12.345)], "i int, v double")
    texts = [r.t for r in values.orderBy("i").select(panel_text(F.col("v")).alias("t")).collect()]
    assert texts[:3] == ["--"] * 3 and texts[3] in ("12.35", "12.34")
    shown = V.panel(V.latest_values(bars_of(spark, golden_rows()), DAILY)).first()
    assert shown.k == "53.62" and shown.obv == "39000.00"


def test_scan_arguments(spark):
    bars = bars_of(spark, golden_rows() + golden_rows("Y"))
    assert scan_bars(bars, ts_code="X", start_date="20250105", end_date="20250109").count() == 5
    assert scan_bars(bars, trade_date="20250105").count() == 2
    assert scan_bars(bars, ts_code="", trade_date="").count() == 40
    page = scan_bars(bars, offset=18, limit=4).collect()
    assert [(r.ts_code, r.trade_date[-2:]) for r in page] == [
        ("X", "19"), ("X", "20"), ("Y", "01"), ("Y", "02"),
    ]
    assert scan_history(bars).columns == ["ts_code", "trade_date", "close", "high", "low", "volume"]


def test_quality_measures(spark):
    bars = bars_of(spark, golden_rows())
    row = R.kdj_hit_rate(bars, DAILY).first()
    # Rows 15 to 19 are scored against the close after them.  Row 15 has K = D and the
    # rest K < D; of the closes after rows 16 to 19 only the first is a fall.
    assert (row.n_scored, row.n_hit) == (5, 1)
    assert -1.0 <= R.obv_close_corr(bars, DAILY).first().obv_close_corr <= 1.0
