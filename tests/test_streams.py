"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import json
import os

import pytest
from fixtures import GOLDEN, bars_of, golden_rows, list_psar, near

from candlewick.operators import rows as R
from candlewick.plans.layout import DAILY, SeriesLayout
from candlewick.sources import messages as M
from candlewick.streaming import jobs as J


def put(spark, rows: list[dict], folder) -> None:
    """One message file per row, with modification times in row order."""
    folder.mkdir(exist_ok=True)
    held = len(list(folder.iterdir()))
    texts = [r.value for r in M.encode(bars_of(spark, rows).coalesce(1)).collect()]
    for i, text in enumerate(texts, start=held):
        path = folder / f"{i:04d}.json"
        path.write_text(text + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def records(spark, folder, files_per_batch=None):
    return R.required_fields(M.decode(M.folder_stream(spark, str(folder), files_per_batch)))


def enriched_rows(spark, folder) -> list:
    rows = spark.read.schema(J.ENRICHED_SCHEMA).parquet(str(folder))
    return rows.orderBy("ts_code", "trade_date").collect()


def assert_golden(rows, first: int = 0) -> None:
    assert len(rows) == 20 - first
    for row, want in zip(rows, GOLDEN[first:]):
        assert row.trade_date == want[0]
        assert all(near(row[n], v) for n, v in zip(R.ENRICHED, want[7:])), (row, want)


@pytest.mark.parametrize("layout", [DAILY, SeriesLayout(chunk_chars=7)], ids=["whole", "cut"])
def test_table_state_over_paced_batches_and_a_restart(spark, tmp_path, layout):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for part in (golden_rows()[:12], golden_rows()[12:]):
        put(spark, part, inbox)
        J.start_enriched_batches(
            records(spark, inbox, 6), out, str(tmp_path / "s"), str(tmp_path / "p"), layout
        ).awaitTermination()
    assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == 4
    assert_golden(enriched_rows(spark, out))


def test_table_state_warm_start(spark, tmp_path):
    put(spark, golden_rows()[13:], tmp_path / "in")
    warm = J.table_state(bars_of(spark, golden_rows()[:13]), DAILY)
    J.start_enriched_batches(
        records(spark, tmp_path / "in", 4), str(tmp_path / "out"), str(tmp_path / "s"),
        str(tmp_path / "p"), DAILY, warm,
    ).awaitTermination()
    assert_golden(enriched_rows(spark, tmp_path / "out"), first=13)


def test_store_state_one_record_per_batch(spark, tmp_path):
    put(spark, golden_rows()[12:], tmp_path / "in")
    warm = J.initial_state(bars_of(spark, golden_rows()[:12]), DAILY)
    J.append_to_folder(
        J.enriched_stream(records(spark, tmp_path / "in", 2), warm),
        str(tmp_path / "out"), str(tmp_path / "p"),
    ).awaitTermination()
    assert_golden(enriched_rows(spark, tmp_path / "out"), first=12)


def test_overlapping_warm_start_counts_repeated_days_twice(spark, tmp_path):
    put(spark, golden_rows()[10:], tmp_path / "in")
    history = bars_of(spark, golden_rows()[:15])
    want = (
        R.enriched_records(
            R.history_live_union(history, bars_of(spark, golden_rows()[10:])),
            SeriesLayout(order=R.UNION_ORDER, chunk_chars=None),
        )
        .where("src_seq = 1").orderBy("trade_date").collect()
    )
    J.start_enriched_batches(
        records(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "s"),
        str(tmp_path / "p"), DAILY, J.table_state(history, DAILY),
    ).awaitTermination()
    got = enriched_rows(spark, tmp_path / "out")
    assert len(got) == len(want) == 10
    for a, b in zip(got, want):
        assert all(near(a[n], b[n], 1e-12) for n in R.ENRICHED)


def test_batch_indicators_see_their_batch_only(spark, tmp_path):
    put(spark, golden_rows(), tmp_path / "in")
    J.start_batch_indicators(
        records(spark, tmp_path / "in", 10), J.folder_sink(str(tmp_path / "out")),
        str(tmp_path / "p"), DAILY,
    ).awaitTermination()
    got = M.decode(J.read_folder_sink(spark, str(tmp_path / "out")), J.INDICATOR_SCHEMA)
    want = R.indicator_rows(bars_of(spark, golden_rows()[:10]), DAILY).unionByName(
        R.indicator_rows(bars_of(spark, golden_rows()[10:]), DAILY)
    )
    assert got.count() == 20
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_empty_and_faulty_batches_write_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.json").write_text('not json\n{"ts_code":"X","close":1}\n')
    J.start_batch_indicators(
        records(spark, tmp_path / "in"), J.folder_sink(str(tmp_path / "out")), str(tmp_path / "p")
    ).awaitTermination()
    assert not (tmp_path / "out").exists()


def test_a_failing_batch_stops_the_query(spark, tmp_path):
    put(spark, golden_rows()[:2], tmp_path / "in")

    def broken(messages, batch_id):
        raise RuntimeError("sink is down")

    query = J.start_batch_indicators(records(spark, tmp_path / "in"), broken, str(tmp_path / "p"))
    with pytest.raises(Exception, match="sink is down"):
        query.awaitTermination()


def late_and_overlapping() -> list[dict]:
    """Golden rows 11 to 20 as live rows, two of them late and one without a date."""
    rows = golden_rows()[10:]
    order = [0, 3, 1, 2, 4, 6, 5, 7, 8, 9]
    live = [dict(rows[i]) for i in order]
    live[4]["trade_date"] = ""
    return live


@pytest.mark.parametrize("layout", [DAILY, SeriesLayout(chunk_chars=7)])
def test_batches_do_not_change_history(spark, tmp_path, layout):
    """One record per batch is the order of arrival; both forms and any pacing whose batches
    are in date order themselves give the same rows."""
    history = bars_of(spark, golden_rows(count=15))
    put(spark, late_and_overlapping(), tmp_path / "in")
    found = {}
    for form in ("table", "store"):
        work = tmp_path / form
        source = records(spark, tmp_path / "in", 1)
        if form == "table":
            warm = J.table_state(history, DAILY)
            J.start_enriched_batches(
                source, str(work / "out"), str(work / "state"), str(work / "p"), layout, warm
            ).awaitTermination()
        else:
            rows = J.enriched_stream(source, J.initial_state(history, DAILY))
            J.append_to_folder(rows, str(work / "out"), str(work / "p")).awaitTermination()
        got = spark.read.schema(J.ENRICHED_SCHEMA).parquet(str(work / "out")).collect()
        found[form] = sorted((r.obv, r.trade_date or "", r.k, r.d, r.j, r.psar) for r in got)
    # The history as one list in order of arrival.
    seen = [(b["high"], b["low"], b["close"]) for b in golden_rows(count=15)]
    volume, want = sum(b["vol"] for b in golden_rows(count=15)), []
    for row in late_and_overlapping():
        seen.append((row["high"], row["low"], row["close"]))
        volume += row["vol"]
        frame = seen[-9:]
        top, low = max(b[0] for b in frame), min(b[1] for b in frame)
        k = 50 * 2 / 3 + (frame[-1][2] - low) / (top - low) * 100 / 3
        d = 50 * 2 / 3 + k / 3
        want.append((volume, row["trade_date"], k, d, 3 * k - 2 * d, list_psar(seen[-10:])))
    for form, rows in found.items():
        assert len(rows) == len(want)
        for got, expected in zip(rows, want):
            assert got[1] == expected[1]
            assert all(near(a, b, 1e-9) for a, b in zip(got[:1] + got[2:], expected[:1] + expected[2:])), form


@pytest.mark.parametrize("files", [None, 3, 5])
def test_pacing_in_date_order_changes_nothing(spark, tmp_path, files):
    history, live = golden_rows(count=15), golden_rows()[10:]
    put(spark, live, tmp_path / "in")
    J.start_enriched_batches(
        records(spark, tmp_path / "in", files),
        str(tmp_path / "out"),
        str(tmp_path / "state"),
        str(tmp_path / "p"),
        DAILY,
        J.table_state(bars_of(spark, history), DAILY),
    ).awaitTermination()
    rows = {r.trade_date: r for r in enriched_rows(spark, tmp_path / "out")}
    assert near(rows["20250114"].psar, 11.0260) and near(rows["20250120"].k, 53.6231884)


def test_records_leave_as_they_came(spark, tmp_path):
    rows = golden_rows(count=3)
    texts = []
    for row, names in zip(rows, (("vol",), ("volume",), ())):
        row = {k: v for k, v in row.items() if k != "vol"}
        texts.append(json.dumps(row | {name: 5.0 for name in names}))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(texts) + "\n")
    J.start_enriched_batches(
        records(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "p"), DAILY
    ).awaitTermination()
    got = [(r.vol, r.volume) for r in enriched_rows(spark, tmp_path / "out")]
    assert got == [(5.0, None), (None, 5.0), (None, None)]


def test_store_form_asks_for_its_store(spark, tmp_path):
    put(spark, golden_rows(count=1), tmp_path / "in")
    before = spark.conf.get(J.STATE_STORE_SETTING)
    spark.conf.set(J.STATE_STORE_SETTING, "other")
    try:
        with pytest.raises(ValueError, match="stateStore"):
            J.enriched_stream(records(spark, tmp_path / "in"))
    finally:
        spark.conf.set(J.STATE_STORE_SETTING, before)
