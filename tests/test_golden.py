"""The golden series, in one piece and cut into chunks."""

from __future__ import annotations

import pytest
from fixtures import GOLDEN, GOLDEN_LISTS, bars_of, golden_rows, near

from candlewick.operators import aggregates as A
from candlewick.operators import rows as R
from candlewick.operators import views as V
from candlewick.plans.layout import SeriesLayout

WHOLE = SeriesLayout(chunk_chars=None)
# A seven-character prefix cuts the twenty days into chunks of 9, 10 and 1 rows.
LAYOUTS = [WHOLE, SeriesLayout(chunk_chars=7), SeriesLayout(chunk_chars=8)]


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: str(x.chunk_chars))
def test_indicator_rows(spark, layout):
    got = R.indicator_rows(bars_of(spark, golden_rows()), layout).orderBy("trade_date").collect()
    assert len(got) == 20
    for row, want in zip(got, GOLDEN):
        assert near(row.rsi, want[5]) and near(row.psar, want[6]), (row, want)


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: str(x.chunk_chars))
def test_enriched_records(spark, layout):
    got = R.enriched_records(bars_of(spark, golden_rows()), layout).orderBy("trade_date").collect()
    assert len(got) == 20
    for row, want in zip(got, GOLDEN):
        for name, value in zip(R.ENRICHED, want[7:]):
            assert near(row[name], value), (row.trade_date, name, row[name], value)


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: str(x.chunk_chars))
def test_all_indicators_agrees_with_both_families(spark, layout):
    bars = bars_of(spark, golden_rows())
    wide = R.all_indicators(bars, layout).orderBy("trade_date").collect()
    for row, want in zip(wide, GOLDEN):
        assert near(row.rsi, want[5]) and near(row.psar_step, want[6])
        assert all(near(row[n], v) for n, v in zip(R.ENRICHED, want[7:]))


@pytest.mark.parametrize("layout", [WHOLE, SeriesLayout(chunk_chars=7)], ids=["whole", "cut"])
@pytest.mark.parametrize("count", [2, 8, 9, 20])
def test_list_forms(spark, layout, count):
    k, d, j, psar, obv = GOLDEN_LISTS[count]
    bars = bars_of(spark, golden_rows(count=count))
    row = A.kdj_of_series(bars, layout).first()
    assert near(row.k, k) and near(row.d, d) and near(row.j, j) and row.n_bars == count
    assert near(A.psar_of_series(bars, layout).first().psar, psar)
    total = A.volume_totals(bars, layout).first()
    assert total.obv == obv and total.has_volume


def test_latest_values_equal_last_enriched_row(spark):
    row = V.latest_values(bars_of(spark, golden_rows()), WHOLE).first()
    assert row.trade_date == "20250120"
    assert all(near(row[n], v) for n, v in zip(R.ENRICHED, GOLDEN[-1][7:]))


def test_second_code_and_row_order_change_nothing(spark):
    other = [dict(r, ts_code="Y", close=r["close"] * 2) for r in golden_rows()]
    mixed = bars_of(spark, list(reversed(golden_rows())) + other).repartition(5)
    got = (
        R.indicator_join(mixed, WHOLE).where("ts_code = 'X'").orderBy("trade_date").collect()
    )
    assert len(got) == 20
    for row, want in zip(got, GOLDEN):
        assert near(row.rsi, want[5]) and near(row.psar, want[6])


def test_chart_series_has_seven_points_per_row(spark):
    rows = V.chart_series(R.enriched_records(bars_of(spark, golden_rows()), WHOLE)).collect()
    assert len(rows) == 7 * 20
    assert {(r.chart, r.series) for r in rows} == {
        ("price", "close"), ("kdj", "K"), ("kdj", "D"), ("kdj", "J"),
        ("obv", "OBV"), ("psar", "close"), ("psar", "PSAR"),
    }
    last = {(r.chart, r.series): r.y for r in rows if r.x == "20250120"}
    assert near(last["psar", "PSAR"], 11.603725) and last["price", "close"] == 11.4
