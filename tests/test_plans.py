"""What the physical plans must look like."""

from __future__ import annotations

import re

from fixtures import bars_of, golden_rows

from candlewick.operators import aggregates as A
from candlewick.operators import rows as R
from candlewick.plans.layout import DAILY, SeriesLayout
from candlewick.queries import daily
from candlewick.sources import messages as M
from candlewick.sources.bars import read_bars, scan_bars
from candlewick.sources.history import look_up, write_history
from conftest import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_predicates_and_prunes_columns(spark, tmp_path):
    bars_of(spark, golden_rows()).write.parquet(str(tmp_path / "bars"))
    bars = read_bars(spark, str(tmp_path / "bars"))
    text = plan(
        scan_bars(bars, "X", start_date="20250103", end_date="20250105", fields=("ts_code", "close"))
    )
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(ts_code,X)" in pushed
    assert "GreaterThanOrEqual(trade_date,20250103)" in pushed
    assert "LessThanOrEqual(trade_date,20250105)" in pushed
    assert "ReadSchema: struct<ts_code:string,trade_date:string,close:double>" in text


def test_bars_read_from_json_and_csv(spark, tmp_path):
    bars = bars_of(spark, golden_rows())
    bars.write.json(str(tmp_path / "json"))
    bars.write.option("header", True).csv(str(tmp_path / "csv"))
    assert read_bars(spark, str(tmp_path / "json"), "json").exceptAll(bars).isEmpty()
    assert read_bars(spark, str(tmp_path / "csv"), "csv", header="true").exceptAll(bars).isEmpty()


def test_one_exchange_and_sort_for_all_windows(spark, tmp_path):
    bars_of(spark, golden_rows()).write.parquet(str(tmp_path / "bars"))
    bars = read_bars(spark, str(tmp_path / "bars"))
    text = plan(R.all_indicators(bars, DAILY))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_code_filter_passes_below_the_windows(spark, tmp_path):
    bars_of(spark, golden_rows()).write.parquet(str(tmp_path / "bars"))
    for layout in (DAILY, SeriesLayout()):
        bars = read_bars(spark, str(tmp_path / "bars"))
        text = plan(R.indicator_rows(bars, layout).where("ts_code = 'X'"))
        scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
        assert scans and all("EqualTo(ts_code,X)" in s for s in scans)


def test_cut_layout_never_groups_a_whole_series_of_bars(spark, tmp_path):
    bars_of(spark, golden_rows()).write.parquet(str(tmp_path / "bars"))
    bars = read_bars(spark, str(tmp_path / "bars"))
    df = R.indicator_rows(bars, SeriesLayout(chunk_chars=7))
    df.collect()
    text = plan(df)
    final = text.split("+- == Initial Plan ==")[0]
    # Bars are shuffled by (series, chunk) once and read again by the second branch.
    assert "ReusedExchange" in final
    assert re.search(r"hashpartitioning\(ts_code#\d+, _chunk#\d+", final)


def test_bar_adapter_aggregates_by_hash_before_the_shuffle(spark):
    text = plan(daily(spark, SF_DIR).select("ts_code", "trade_date", "open", "close"))
    assert "SortAggregate" not in text
    assert "partial_min_by" in text and "partial_max_by" in text
    scan = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "l_tax" not in scan and "l_discount" not in scan


def test_last_bars_limits_before_the_shuffle(spark):
    bars = daily(spark, SF_DIR).select("ts_code", "trade_date", "close")
    text = plan(A.last_bars(bars, 9, DAILY))
    assert text.count("WindowGroupLimit") == 2


def test_history_lookup_reads_only_the_months_asked_for(spark, tmp_path):
    folder = str(tmp_path / "history")
    rows = golden_rows() + [dict(r, trade_date=str(int(r["trade_date"]) + 300)) for r in golden_rows()]
    write_history(bars_of(spark, rows), folder)
    found = look_up(spark, folder, "X", "20250102", "20250110")
    assert found.count() == 9 and "month" not in found.columns
    text = plan(look_up(spark, folder, "X", "20250102", "20250110"))
    assert re.search(r"PartitionFilters: \[.*month", text)
    assert "EqualTo(ts_code,X)" in text
    assert look_up(spark, folder).count() == 40


def test_messages_are_parsed_once(spark, tmp_path):
    M.write_folder(M.encode(bars_of(spark, golden_rows())), str(tmp_path / "in"))
    rows = R.required_fields(M.decode(spark.read.text(str(tmp_path / "in"))))
    assert plan(rows).count("from_json(") == 1


def test_no_frame_is_summed_anew_for_every_row(spark):
    """A frame from the current row to the end costs quadratic time in Spark."""
    bars = bars_of(spark, golden_rows())
    for layout in (DAILY, SeriesLayout(chunk_chars=7)):
        for df in (
            R.all_indicators(bars, layout),
            R.kdj_hit_rate(bars, layout),
            A.kdj_of_series(bars, layout),
        ):
            assert not re.search(r"RowFrame, [^)]*currentrow\$\(\), unboundedfollowing", plan(df))
