"""Cut series give the results of whole ones, also when one series dominates."""

from __future__ import annotations

import random

import pytest
from fixtures import bars_of, list_kdj, list_psar, near, series

from candlewick.operators import aggregates as A
from candlewick.operators import indicators as I
from candlewick.operators import rows as R
from candlewick.operators import windows as W
from candlewick.plans.layout import SeriesLayout, with_context
from candlewick.sources.bars import BAR_FIELDS

WHOLE = SeriesLayout(chunk_chars=None)


def random_prices(seed: int, count: int) -> list[tuple]:
    rng, close, out = random.Random(seed), 100.0, []
    for _ in range(count):
        close = max(1.0, close + rng.uniform(-3, 3))
        high, low = close + rng.uniform(0, 2), close - rng.uniform(0, 2)
        out.append((high, low, close, float(rng.randint(1, 9))))
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with far more rows than the others, some of them very short."""
    rows = series("HOT", random_prices(1, 400))
    for i, count in enumerate((1, 3, 14, 15, 16, 40)):
        # Widely spaced dates: most chunks of these series hold one or two rows.
        part = series(f"C{i}", random_prices(i + 2, count))
        rows += [dict(r, trade_date=str(20250101 + 7 * n)) for n, r in enumerate(part)]
    return bars_of(spark, rows).cache()


# Prefixes of 8, 7 and 6 characters: chunks of one, up to ten, up to a hundred rows.
@pytest.mark.parametrize("chars", [6, 7, 8])
def test_cut_equals_whole(skewed, chars):
    cut = SeriesLayout(chunk_chars=chars)
    for build in (
        lambda layout: R.all_indicators(skewed, layout),
        lambda layout: W.price_delta(skewed, layout),
        lambda layout: W.rolling_extremes(skewed, layout),
        lambda layout: R.kdj_hit_rate(skewed, layout),
    ):
        whole, pieces = build(WHOLE), build(cut)
        assert whole.columns == pieces.columns
        assert whole.exceptAll(pieces).isEmpty() and pieces.exceptAll(whole).isEmpty()


def test_halo_is_a_few_rows_per_chunk(skewed):
    cut = SeriesLayout(chunk_chars=7)
    halo = with_context(skewed.select(*BAR_FIELDS), 15, cut).where("_halo")
    assert halo.groupBy("ts_code", "_chunk").count().where("count > 15").isEmpty()


@pytest.mark.parametrize("chars", [None, 6, 7])
def test_list_forms_equal_brute_force(skewed, chars):
    layout = SeriesLayout(chunk_chars=chars)
    lists: dict[str, list] = {}
    for r in skewed.orderBy("ts_code", "trade_date").collect():
        lists.setdefault(r.ts_code, []).append((r.high, r.low, r.close))
    for row in A.psar_of_series(skewed, layout).collect():
        assert near(row.psar, list_psar(lists[row.ts_code]), 1e-9), row
    for row in A.kdj_of_series(skewed, layout).collect():
        want = list_kdj(lists[row.ts_code])
        assert all(near(g, w, 1e-9) for g, w in zip((row.k, row.d, row.j), want)), (row, want)


def test_recursion_without_any_reversal_settles(spark):
    """No chunk resets the state, so every chunk waits for the one before it."""
    prices = [(10.0 + i, 9.5 + i, 9.8 + i, 1.0) for i in range(60)]
    got = A.psar_of_series(bars_of(spark, series("UP", prices)), SeriesLayout(chunk_chars=7))
    assert near(got.first().psar, list_psar([p[:3] for p in prices]), 1e-12)



def test_invariants(skewed):
    rows = R.all_indicators(skewed, WHOLE).collect()
    for r in rows:
        assert r.rsi is None or 0.0 <= r.rsi <= 100.0
        assert r.k is None or near(r.j, 3 * r.k - 2 * r.d, 1e-9)
    hot = sorted((r for r in rows if r.ts_code == "HOT"), key=lambda r: r.trade_date)
    volumes = [r.obv for r in hot if r.obv is not None]
    assert volumes == sorted(volumes) and len(volumes) == 400 - 14
    bars = [(r.high, r.low, r.close) for r in hot]
    for end in (15, 16, 200, 400):
        assert near(hot[end - 1].psar, list_psar(bars[end - 10 : end]), 1e-9)
    assert I.psar(skewed, WHOLE).count() == skewed.count()
