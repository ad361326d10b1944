"""Whole-series results: MACD, the recursion over long series, and the latest state."""

from __future__ import annotations

import random

import pytest
from fixtures import bars_of, golden_rows, list_psar
from pyspark.sql import functions as F

from candlewick.functions import reversal_scan as scan
from candlewick.functions.expressions import panel_text
from candlewick.operators import aggregates as A
from candlewick.operators import averages as AV
from candlewick.operators import views as V
from candlewick.plans.layout import DAILY, SeriesLayout

CUTS = [DAILY, SeriesLayout(chunk_chars=3), SeriesLayout(), SeriesLayout(chunk_chars=6)]


def date(i: int) -> str:
    return f"{2000 + i // 100:04d}{i // 10 % 10:02d}{i % 10:02d}"


def walk(seed: int, n: int, kind: str = "walk") -> list[tuple]:
    """(high, low, close) of a series."""
    r = random.Random(seed)
    price, bars = 100.0, []
    for _ in range(n):
        price = price + 1 if kind == "up" else r.uniform(10, 100) if kind == "noise" else price * (1 + r.gauss(0, 0.02))
        spread = 0.01 if kind == "up" else r.random()
        bars.append((price + spread, price - spread, price))
    return bars


def table(spark, named: dict[str, list[tuple]]):
    rows = [
        dict(ts_code=code, trade_date=date(i), high=h, low=lo, close=c)
        for code, bars in named.items()
        for i, (h, lo, c) in enumerate(bars)
    ]
    random.Random(0).shuffle(rows)
    return bars_of(spark, rows).select("ts_code", "trade_date", "high", "low", "close").repartition(5)


# -- MACD ----------------------------------------------------------------------------


def plain_macd(closes: list, fast: int, slow: int, signal: int) -> list[tuple]:
    out, f, s, g = [], None, None, 0.0
    for close in closes:
        if close is not None and f is None:
            f = s = close
        elif close is not None:
            f += 2 / (fast + 1) * (close - f)
            s += 2 / (slow + 1) * (close - s)
            g += 2 / (signal + 1) * (f - s - g)
        out.append((None, None) if f is None else (f - s, g))
    return out


@pytest.fixture(scope="module")
def closes(spark):
    named = {c: walk(i, 430) for i, c in enumerate("ABC")}
    r = random.Random(4)
    # Two whole chunks without a close, one of them the first, and gaps.
    named["B"] = [
        (h, lo, None if i < 130 or 200 <= i < 330 or r.random() < 0.1 else c) for i, (h, lo, c) in enumerate(named["B"])
    ]
    named["N"] = [(1.0, 1.0, None)] * 3
    named["ONE"] = [(1.0, 1.0, 7.0)]
    return named, table(spark, named)


@pytest.mark.parametrize("periods", [(12, 26, 9), (9, 26, 9), (5, 9, 9), (1, 5, 1), (1, 1, 1)])
@pytest.mark.parametrize("layout", CUTS, ids=["whole", "cut3", "cut4", "cut6"])
def test_macd_equals_the_recursion(closes, periods, layout):
    named, bars = closes
    want = {c: plain_macd([b[2] for b in rows], *periods) for c, rows in named.items()}
    for row in AV.macd(bars, layout, *periods).collect():
        at = next(i for i in range(430) if date(i) == row.trade_date)
        dif, sig = want[row.ts_code][at]
        if dif is None:
            assert row.macd is None and row.signal is None and row.histogram is None
        else:
            assert abs(row.macd - dif) < 1e-9 and abs(row.signal - sig) < 1e-9
            assert row.histogram == row.macd - row.signal


def test_macd_of_blocks_within_a_task(closes, monkeypatch):
    monkeypatch.setattr(AV, "_LARGEST", 7.0)  # some thirty bars
    named, bars = closes
    got = AV.macd(bars, DAILY).where("ts_code = 'A'").orderBy("trade_date").collect()
    want = plain_macd([b[2] for b in named["A"]], 12, 26, 9)
    assert all(abs(r.macd - d) < 1e-9 and abs(r.signal - g) < 1e-9 for r, (d, g) in zip(got, want, strict=True))


def test_macd_refuses_senseless_periods(closes):
    for periods in ((0, 26, 9), (30, 26, 9), (12, 26, 0)):
        with pytest.raises(ValueError):
            AV.macd(closes[1], DAILY, *periods)


def test_macd_keeps_the_columns_it_gets(spark):
    bars = bars_of(spark, golden_rows()).withColumn("n", F.lit(3)).withColumn("first", F.lit("x"))
    rows = AV.macd(bars, SeriesLayout(chunk_chars=7))
    assert rows.columns == [*bars.columns, "macd", "signal", "histogram"]
    assert {(r.n, r.first) for r in rows.select("n", "first").collect()} == {(3, "x")}
    assert AV.macd(bars.limit(0), DAILY).count() == 0


# -- the recursion -------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_series(spark):
    named = {f"W{i}": walk(i, 500) for i in range(8)} | {f"N{i}": walk(i, 500, "noise") for i in range(4)}
    named["UP"] = walk(0, 2500, "up")
    named["ONE"] = walk(0, 1)
    named["GAP"] = [(None, 1.0, 1.0) if i == 333 else b for i, b in enumerate(walk(1, 500))]
    named["START"] = [(h, lo, None if i == 0 else c) for i, (h, lo, c) in enumerate(walk(2, 500))]
    return named, table(spark, named)


def level(bars: list[tuple]):
    known = bars[0][2] is not None and all(h is not None for h, _, _ in bars)
    return list_psar(bars) if known else None


@pytest.mark.parametrize("spare", [scan.SPARE, 1])
@pytest.mark.parametrize("layout", CUTS, ids=["whole", "cut3", "cut4", "cut6"])
def test_long_recursion_is_exact(long_series, layout, spare):
    """25 yearly chunks of one trend among them; a small `spare` loses series on the way."""
    named, bars = long_series
    got = {r.ts_code: r.psar for r in A.psar_of_series(bars, layout, spare=spare).collect()}
    assert got == {code: level(rows) for code, rows in named.items()}


def chained(bars: list[tuple], size: int, spare: int) -> tuple[scan.Chain, int]:
    chain, taken = scan.Chain(0.02, 0.2), 0
    for at in range(0, len(bars), size):
        run = scan.Forgetting(0.02, 0.2, spare)
        head = [b for b in bars[at : at + size] if run.takes(b[0], b[1])]
        for i, bar in enumerate(head):
            chain.take(*bar, run.mark() if i == len(head) - 1 else None)
        taken += len(head)
    return chain, taken


def test_a_chain_is_right_or_says_that_it_is_lost():
    lost = {1: 0, scan.SPARE: 0}
    for spare in lost:
        share = []
        for seed in range(300):
            bars = walk(seed, 1500, ("walk", "noise")[seed % 2])
            chain, taken = chained(bars, 366, spare)
            share.append(taken / len(bars))
            lost[spare] += chain.lost
            assert chain.lost or chain.level == list_psar(bars)
        assert sum(share) / len(share) < 0.45
    assert lost[1] > 100 and lost[scan.SPARE] <= 3


def test_recursion_runs_no_job_while_it_is_built(spark, tmp_path):
    path = str(tmp_path / "bars")
    table(spark, {"A": walk(0, 300)}).write.parquet(path)
    bars = spark.read.parquet(path)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs(None))
    frame = A.psar_of_series(bars, SeriesLayout())
    assert set(jobs(None)) == before
    assert abs(frame.first().psar - list_psar(walk(0, 300))) < 1e-12


# -- latest state --------------------------------------------------------------------


@pytest.mark.parametrize("layout", [DAILY, SeriesLayout(chunk_chars=6)], ids=["whole", "cut"])
def test_latest_state_reads_bars_once_and_joins_nothing(spark, tmp_path, layout):
    path = str(tmp_path / "bars")
    bars_of(spark, golden_rows("X") + golden_rows("Y", 7)).write.parquet(path)
    latest = V.latest_values(spark.read.parquet(path), layout)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Window" not in plan
    state = {r.ts_code: r for r in A.series_state(spark.read.parquet(path), layout).collect()}
    assert [b.trade_date for b in state["X"].tail] == [g["trade_date"] for g in golden_rows()[10:]]
    assert (state["X"].n, state["Y"].n, len(state["Y"].tail)) == (20, 7, 7)


def test_panel_text_rounds_the_number_not_its_digits(spark):
    values = [83380.185, 0.125, 0.375, -0.004, 1234567.891, -2.5, 1e16]
    want = ["83380.18", "0.12", "0.38", "-0.00", "1234567.89", "-2.50", "10000000000000000.00"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.t for r in rows.orderBy("i").select(panel_text(F.col("v")).alias("t")).collect()] == want
