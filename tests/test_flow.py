"""Stream state, repeats, rejects, replay, pace and the history that takes late rows."""

from __future__ import annotations

import json
import os
import time

import pytest
from fixtures import GOLDEN, bars_of, golden_rows, near, series
from pyspark.sql import functions as F
from test_streams import assert_golden, enriched_rows, put, records

from candlewick.functions import sql_forms as SQL
from candlewick.operators import aggregates as A
from candlewick.operators import indicators as I
from candlewick.operators import rows as R
from candlewick.plans.layout import DAILY
from candlewick.sources import history as H
from candlewick.sources import messages as M
from candlewick.sources import replay as RP
from candlewick.streaming import intake as IN
from candlewick.streaming import jobs as J
from candlewick.streaming.pace import PaceLog
from candlewick.streaming.state_log import StateLog, live_spans

KEYED = J.T.StructType([J.T.StructField("k", J.T.StringType()), J.T.StructField("v", J.T.LongType())])

# -- state log -----------------------------------------------------------------------


def test_spans_cover_all_batches_once_in_few_tables():
    for n in range(200):
        spans = live_spans(n)
        assert [b for low, high in spans for b in range(low, high + 1)] == list(range(n))
        assert len(spans) <= n.bit_length()


def rows_of(spark, path) -> int:
    return spark.read.parquet(path).count()


def test_log_keeps_the_newest_row_of_each_key(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "s"), KEYED, "k", buckets=4)
    log.start(spark.createDataFrame([(f"k{i}", -1) for i in range(20)], KEYED))
    log.start(spark.createDataFrame([("k0", -9)], KEYED))  # a restart keeps the first
    held = {f"k{i}": -1 for i in range(20)}
    for n in range(9):
        log.clean(n)
        touched = [f"k{i}" for i in range(n, n + 3)] + [f"new{n}"]
        keys = spark.createDataFrame([(k,) for k in touched + touched], "k string")
        changed = spark.createDataFrame([(k, n) for k in touched], KEYED)
        for _ in range(2):  # the batch runs again
            assert {r.k: r.v for r in log.before(n, keys).collect()} == {k: held[k] for k in touched if k in held}
            log.write(n, changed)
        held |= dict.fromkeys(touched, n)
    keys = spark.createDataFrame([(k,) for k in held], "k string")
    assert {r.k: r.v for r in log.before(9, keys).collect()} == held
    log.clean(9)
    assert sorted(os.listdir(tmp_path / "s")) == sorted(["warm", "batches-0-7", "batches-8-8"])


def test_log_of_nothing(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "s"), KEYED, "k")
    empty = spark.createDataFrame([], KEYED)
    log.write(0, empty)
    assert log.before(1, spark.createDataFrame([("a",)], "k string")).count() == 0
    assert log.before(0, empty).count() == 0


def test_state_costs_what_arrives(spark, tmp_path):
    """1,000 series, batches of 10: what is written again follows the ten, not the thousand."""
    many = [r for i in range(1000) for r in series(f"S{i}", [(2.0, 1.0, 1.5, 5.0)])]
    warm = J.table_state(bars_of(spark, many), DAILY)
    inbox, state = tmp_path / "in", tmp_path / "s"
    bars = [dict(ts_code=f"S{i}", trade_date="20250102", high=2.0, low=1.0, close=1.5, vol=7.0) for i in range(40)]
    inbox.mkdir()
    for part in range(4):
        texts = [r.value for r in M.encode(bars_of(spark, bars[10 * part : 10 * part + 10])).collect()]
        path = inbox / f"{part}.json"
        path.write_text("\n".join(texts) + "\n")
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    written = []
    original = StateLog._store

    def counting(self, rows, path):
        original(self, rows, path)
        written.append(rows_of(spark, path))

    StateLog._store = counting
    try:
        J.start_enriched_batches(
            records(spark, inbox, 1), str(tmp_path / "out"), str(state), str(tmp_path / "p"), DAILY, warm, buckets=4
        ).awaitTermination()
    finally:
        StateLog._store = original
    assert written == [1000, 10, 20, 10, 40]
    log = StateLog(spark, str(state), J.TABLE_STATE, "ts_code", 4)
    ends = {r.ts_code: (r.n, r.obv) for r in log.before(4, bars_of(spark, many).select("ts_code")).collect()}
    assert len(ends) == 1000
    assert all(ends[f"S{i}"] == ((2, 12.0) if i < 40 else (1, 5.0)) for i in range(1000))


def test_stream_takes_its_callers_parameters(spark, tmp_path):
    options = dict(warmup=3, period=5, size=12, af_step=0.05, af_max=0.5)
    put(spark, golden_rows(), tmp_path / "in")
    J.start_enriched_batches(
        records(spark, tmp_path / "in", 3), str(tmp_path / "out"), str(tmp_path / "s"), str(tmp_path / "p"), DAILY, **options
    ).awaitTermination()
    want = R.enriched_records(bars_of(spark, golden_rows()), DAILY, **options).orderBy("trade_date").collect()
    got = enriched_rows(spark, tmp_path / "out")
    assert len(got) == 20 and got[3].obv is not None
    assert all(near(g[n], w[n]) for g, w in zip(got, want, strict=True) for n in R.ENRICHED)


# -- repeats and rejects -------------------------------------------------------------


def test_repeats_go_and_state_is_bounded_by_the_watermark(spark, tmp_path):
    def drain():
        rows = IN.without_repeats(records(spark, tmp_path / "in", 5), "5 days").select("ts_code", "trade_date", "vol")
        query = J.append_to_folder(rows, str(tmp_path / "out"), str(tmp_path / "p"))
        query.awaitTermination()
        return query

    rows = golden_rows()
    # Each half again, one batch later, with another volume.
    again = [dict(r, vol=-1.0) for r in rows]
    put(spark, [*rows[:5], *rows[5:10], *again[5:10], *rows[10:15], *rows[15:20], *again[0:5]], tmp_path / "in")
    query = drain()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.trade_date for r in got) == [g[0] for g in GOLDEN] and all(r.vol > 0 for r in got)
    # The last five repeats are older than the watermark and counted.
    assert IN.late_rows(query) == 5
    # A key is forgotten five days after the watermark has passed its date plus the delay.
    assert IN.state_rows(query) <= 11
    put(spark, [dict(rows[0], trade_date="20260101"), dict(rows[0], trade_date=None)], tmp_path / "in")
    drain()
    put(spark, [dict(rows[0], trade_date="20260102")], tmp_path / "in")
    assert IN.state_rows(drain()) <= 2


def test_rejects_are_told_apart_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    good = json.dumps(dict(ts_code="X", trade_date="20250101", high=2, low=1, close=1.5))
    lines = [good, "no json", json.dumps(dict(ts_code="X", close=1)), json.dumps(dict(close=1, high=1, low=1)), "[]", good]
    for i, line in enumerate(lines):
        (inbox / f"{i}.json").write_text(line + "\n")
        os.utime(inbox / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    folders = [str(tmp_path / x) for x in ("good", "bad")]
    for run in range(2):  # from the start again, into the same folders
        IN.start_intake(M.folder_stream(spark, str(inbox), 2), *folders, str(tmp_path / f"p{run}")).awaitTermination()
        accepted = spark.read.schema(M.MESSAGE_SCHEMA).parquet(folders[0]).collect()
        rejected = spark.read.schema(IN.REJECT_SCHEMA).parquet(folders[1]).collect()
        assert len(accepted) == 2 and len(accepted) + len(rejected) == len(lines)
        assert {(r.value, r.reason) for r in rejected} == {
            (lines[1], "unreadable"), (lines[2], "without high, low"), (lines[3], "unreadable"), (lines[4], "unreadable")
        }
        assert sum(1 for r in rejected if r.reason == "unreadable") == 3


def test_dates_and_hours_have_times(spark):
    dates = [("20250102",), ("2025010213",), ("",), (None,), ("x",), ("20251301",)]
    rows = spark.createDataFrame(dates, "d string").select(IN.dated(F.col("d")).cast("string").alias("t")).collect()
    assert [r.t for r in rows] == ["2025-01-02 00:00:00", "2025-01-02 13:00:00", None, None, None, None]


# -- replay and pace -----------------------------------------------------------------


def test_replay_gives_places_in_date_order(spark, tmp_path):
    bars = bars_of(spark, golden_rows("B") + golden_rows("A")).repartition(3)
    folder = str(tmp_path / "r")
    assert RP.store_replay(bars, folder, block_rows=7) == 40
    rows = RP.due_rows(spark, folder, 0, 39, 7).orderBy("at").collect()
    assert [r.at for r in rows] == list(range(40))
    assert [(r.trade_date, r.ts_code) for r in rows] == sorted((g[0], c) for g in GOLDEN for c in "AB")
    part = RP.due_rows(spark, folder, 8, 12, 7)
    assert [r.at for r in part.orderBy("at").collect()] == [8, 9, 10, 11, 12]
    assert "block" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]
    assert RP.store_replay(bars.limit(0), str(tmp_path / "none")) == 0


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path / "r")
    RP.store_replay(bars_of(spark, golden_rows()), folder, block_rows=6)
    seen: dict[int, list[int]] = {}

    def keep(rows, batch_id):
        seen[batch_id] = sorted(r.at for r in rows.collect())

    for _ in range(5):
        RP.start_replay(spark, folder, keep, str(tmp_path / "p"), rows_per_batch=8, block_rows=6).awaitTermination()
    assert seen == {0: list(range(8)), 1: list(range(8, 16)), 2: list(range(16, 20))}
    with pytest.raises(ValueError):
        RP.start_replay(spark, folder, keep, str(tmp_path / "p"))


def test_replay_by_rate_is_paced_and_logged(spark, tmp_path):
    folder = str(tmp_path / "r")
    RP.store_replay(bars_of(spark, golden_rows()), folder)
    log = PaceLog(spark, str(tmp_path / "pace"))
    spark.streams.addListener(log)
    seen: list[int] = []
    try:
        query = RP.start_replay(
            spark,
            folder,
            lambda rows, _: seen.extend(r.at for r in rows.collect()),
            str(tmp_path / "p"),
            rows_per_second=5,
            processing_time="1 second",
        )
        began = time.time()
        while len(seen) < 20 and time.time() - began < 60:
            time.sleep(0.2)
        took = time.time() - began
        query.stop()
        deadline = time.time() + 20
        while log.flush() == 0 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert sorted(seen) == list(range(20)) and took >= 3
    rows = log.read().where("n_rows > 0").collect()
    assert rows and all(r.seconds > 0 and near(r.rows_per_second, r.n_rows / r.seconds) for r in rows)
    assert all(r.n_rows % 5 == 0 for r in rows)


# -- history -------------------------------------------------------------------------


def months(folder) -> dict[str, set]:
    return {d: set(os.listdir(folder / d)) for d in os.listdir(folder) if d.startswith("month=")}


def test_upsert_touches_only_its_months(spark, tmp_path):
    folder = tmp_path / "h"
    old = [(c, f"2025{m:02d}{d:02d}", 1.0) for c in "AB" for m in (1, 2, 3) for d in (1, 2)] + [("U", None, 1.0)]
    H.write_history(spark.createDataFrame(old, "ts_code string, trade_date string, close double"), str(folder))
    before = months(folder)
    new = [("A", "20250202", 2.0), ("C", "20250201", 2.0), ("A", "20250401", 2.0), ("A", "20250401", 3.0)]
    rows = spark.createDataFrame(new, "ts_code string, trade_date string, close double")
    want = {(c, d): v for c, d, v in old} | {(c, d): v for c, d, v in new}
    for _ in range(2):  # a rerun changes nothing
        H.upsert_history(spark, rows, str(folder))
        got = [(r.ts_code, r.trade_date, r.close) for r in spark.read.parquet(str(folder)).collect()]
        assert {(c, d): v for c, d, v in got} == want and len(got) == len(want)
    after = months(folder)
    assert all(after[m] == files for m, files in before.items() if m != "month=202502")
    H.upsert_history(spark, spark.createDataFrame([("U", None, 5.0)], rows.schema), str(folder))
    assert [r.close for r in spark.read.parquet(str(folder)).where("ts_code = 'U'").collect()] == [5.0]
    H.upsert_history(spark, rows.limit(0), str(folder))
    fresh = tmp_path / "fresh"
    H.upsert_history(spark, rows, str(fresh))
    assert spark.read.parquet(str(fresh)).count() == 3


# -- SQL -----------------------------------------------------------------------------


def test_sql_functions_equal_the_frames(spark):
    gaps = series("G", [(None if i == 12 else 2.0 + i % 5, 1.0 + i % 3, None if i == 20 else 1.5 + i % 4, None) for i in range(40)])
    bars = bars_of(spark, golden_rows() + gaps + golden_rows("S", 3))
    bars.createOrReplaceTempView("sql_bars")
    assert set(SQL.register(spark, "sql_bars")) == set(SQL.SCALARS) | set(SQL.TABLES)

    def over(n):
        return f"collect_list(struct(high, low, close)) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"

    for period, size, step in ((14, 10, 0.02), (3, 6, 0.1)):
        got = spark.sql(
            f"""SELECT ts_code, trade_date, rsi_of({over(period + 1)}, {period}) AS rsi, kdj_of({over(period - 1)}, {period}) AS kdj,
            psar_of({over(size - 1)}, {step}D) AS psar FROM sql_bars"""
        )
        want = I.rsi(bars, DAILY, period).select("ts_code", "trade_date", F.col("rsi").alias("w_rsi"))
        want = want.join(I.kdj(bars, DAILY, period).select("ts_code", "trade_date", "k", "d", "j"), ["ts_code", "trade_date"])
        turns = R.enriched_records(bars, DAILY, warmup=0, size=size, af_step=step)
        want = want.join(turns.select("ts_code", "trade_date", F.col("psar").alias("w_psar")), ["ts_code", "trade_date"])
        rows = got.join(want, ["ts_code", "trade_date"]).collect()
        assert len(rows) == 63
        for r in rows:
            assert near(r.rsi, r.w_rsi) and near(r.psar, r.w_psar), r
            assert all(near(r.kdj[x] if r.kdj else None, r[x]) for x in "kdj"), r
    for period in (9, 4):
        got = {r.ts_code: r for r in spark.sql(f"SELECT * FROM kdj_by_series({period})").collect()}
        for w in A.kdj_of_series(bars, DAILY, period).collect():
            assert got[w.ts_code].n_bars == w.n_bars and all(near(got[w.ts_code][x], w[x]) for x in "kdj")
    for step in (0.02, 0.1):
        got = {r.ts_code: r.psar for r in spark.sql(f"SELECT * FROM psar_by_series({step}D, 0.2D)").collect()}
        assert got == {w.ts_code: w.psar for w in A.psar_of_series(bars, DAILY, step).collect()}
    got = {r.ts_code: r.obv for r in spark.sql("SELECT * FROM obv_by_series()").collect()}
    assert got == {w.ts_code: w.obv for w in A.volume_totals(bars, DAILY).collect()}
    with pytest.raises(ValueError):
        SQL.register(spark, "a; DROP TABLE b")


def test_golden_through_the_log(spark, tmp_path):
    """Twenty batches of one bar each: every level of the log is merged."""
    put(spark, golden_rows(), tmp_path / "in")
    J.start_enriched_batches(
        records(spark, tmp_path / "in", 1), str(tmp_path / "out"), str(tmp_path / "s"), str(tmp_path / "p"), DAILY, buckets=2
    ).awaitTermination()
    assert_golden(enriched_rows(spark, tmp_path / "out"))


def test_undated_records_keep_their_null(spark, tmp_path):
    put(spark, [dict(r, trade_date=None) if i in (3, 7) else r for i, r in enumerate(golden_rows())], tmp_path / "in")
    rows = J.enriched_stream(records(spark, tmp_path / "in"))
    J.append_to_folder(rows, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    got = spark.read.schema(J.ENRICHED_SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert len(got) == 20 and sum(r.trade_date is None for r in got) == 2 and "" not in {r.trade_date for r in got}
