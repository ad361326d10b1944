"""The registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from candlewick.functions import sql_forms as SQL
from candlewick.operators import aggregates as A
from candlewick.operators import averages as AV
from candlewick.operators import indicators as I
from candlewick.operators import rows as R
from candlewick.operators import views as V
from candlewick.operators import windows as W
from candlewick.plans.layout import DAILY, HOURLY, SeriesLayout
from candlewick.plans.scratch import drop_folder, new_folder, no_shuffle_left
from candlewick.sources import history as H
from candlewick.sources import messages as M
from candlewick.sources import replay as RP
from candlewick.sources.bars import (
    BAR_FIELDS,
    HISTORY_FIELDS,
    daily_bars,
    hourly_bars,
    scan_bars,
    scan_history,
)
from candlewick.streaming import intake as IN
from candlewick.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the reference SQL (see `oracle`).
SCAN_START, SCAN_END = "19960101", "20001231"
PAGE_OFFSET, PAGE_LIMIT = 1000, 500
LAST_K = 9
# History is preloaded up to one date, live rows start at an earlier one.
HISTORY_END, LIVE_START = "19991231", "19990701"
# The replayed stream arrives in two parts, cut after this date.
STREAM_CUT = "19980630"
# The paced streams arrive in parts cut after these dates; every fifth volume is a part late.
PACE_CUTS = ("19951231", "19981231")
WARM_PACE_CUTS = ("20000331", "20010331")
DEDUP_DELAY = "400 days"
EMPTY_BATCHES_SETTING = "spark.sql.streaming.noDataMicroBatches.enabled"
REPLAY_BATCHES = 6
SCAN_CODE, SCAN_DAY = "7", "19970310"

# The list-form folds run on yearly chunks, the hourly queries on ten-day ones.
YEARLY = SeriesLayout()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"), **bounds)


def hourly(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    return hourly_bars(table(spark, sf_dir, "events"), **bounds)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that summation order does not show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def to_cents(df: DataFrame) -> DataFrame:
    """Averages over a whole series add up in another order than the reference SQL does, so
    their last digits differ."""
    return df.withColumns({c: F.round(c, 2) for c in ("macd", "signal", "histogram")})


def over_daily(transform: Callable[[DataFrame], DataFrame], *fields: str) -> Query:
    """Query that applies a transform to the named fields of the daily bars."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(transform(daily(spark, sf_dir, fields=fields or BAR_FIELDS)))

    return query


def over_hourly(transform: Callable[[DataFrame], DataFrame], *fields: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(transform(hourly(spark, sf_dir, fields=fields or BAR_FIELDS)))

    return query


KEY = ("ts_code", "trade_date")
CLOSE = (*KEY, "close")
PRICES = (*KEY, "high", "low", "close")
NARROW = (*KEY, "close", "high", "low", "vol")
OUT_ENRICHED = (*KEY, *R.ENRICHED)


# -- scans and messages -----------------------------------------------------------


def bars_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily(spark, sf_dir, start_date=SCAN_START, end_date=SCAN_END))


def bars_scan_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = dict(ts_code=SCAN_CODE, start_date=SCAN_START, end_date=SCAN_END)
    return rounded(daily(spark, sf_dir, **bounds))


def bars_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dict(start_date=SCAN_DAY, end_date=SCAN_DAY, fields=NARROW)
    return rounded(scan_bars(daily(spark, sf_dir, **day), trade_date=SCAN_DAY, fields=NARROW))


def partial_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars as messages in which some fields are missing or renamed.

    Which field is missing follows from the volume, so all cases occur.
    """
    case = F.pmod("vol", F.lit(7))
    bars = daily(spark, sf_dir)
    return M.encode(
        bars.select(
            "ts_code",
            F.when(case != 5, F.col("trade_date")).alias("trade_date"),
            F.when(case != 1, F.col("high")).alias("high"),
            F.when(case != 2, F.col("low")).alias("low"),
            F.when(case != 3, F.col("close")).alias("close"),
            F.when(case.isin(0.0, 1.0, 4.0), F.col("vol")).alias("vol"),
            F.when(case.isin(2.0, 4.0, 5.0), F.col("vol") + 0.5).alias("volume"),
        )
    )


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.required_fields(M.decode(partial_messages(spark, sf_dir)))
    return rounded(R.with_defaults(rows).select(*PRICES))


def volume_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_defaults(M.decode(partial_messages(spark, sf_dir)))
    return rounded(rows.select(*KEY, "volume"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.decode(M.encode(daily(spark, sf_dir)))
    return rounded(rows.select(*BAR_FIELDS))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    props = T.StructType([T.StructField("k", T.LongType())])
    return events.select("event_id", F.from_json("props", props).alias("data")).select(
        "event_id", "data.*"
    )


# -- sets and views ---------------------------------------------------------------


def history_and_live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Narrow bars split into an overlapping history and live part."""
    history = daily(spark, sf_dir, end_date=HISTORY_END, fields=NARROW)
    live = daily(spark, sf_dir, start_date=LIVE_START, fields=NARROW)
    return history, live


def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily(spark, sf_dir, start_date=LIVE_START, fields=HISTORY_FIELDS)
    return rounded(scan_history(bars, start_date=LIVE_START))


def history_live_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both parts hold unique daily bars, so a series stays short.
    layout = SeriesLayout(order=R.UNION_ORDER, chunk_chars=None)
    return rounded(W.running_volume(R.history_live_union(*history_and_live(spark, sf_dir)), layout))


def history_live_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.history_live_dedup(*history_and_live(spark, sf_dir)))


def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "history")
    enriched = R.enriched_records(daily(spark, sf_dir).select(*NARROW), DAILY)
    H.write_history(enriched.select(*KEY, "close", *R.ENRICHED), folder)
    return rounded(H.look_up(spark, folder, start_date=SCAN_START, end_date=SCAN_END))


# -- streams ----------------------------------------------------------------------


def stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "decoded")
    # Names and digits, several times the bars: packed, as many files as the shuffle has tasks.
    M.write_folder(M.encode(daily(spark, sf_dir)), inbox, compression="gzip")
    rows = M.decode(M.folder_stream(spark, inbox)).select(*BAR_FIELDS)
    J.append_to_folder(rows, out, new_folder(spark, "progress")).awaitTermination()
    return rounded(spark.read.schema(rows.schema).parquet(out))


def stream_batch_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches, each its own history."""
    out, progress = new_folder(spark, "indicators"), new_folder(spark, "progress")

    def start(messages: DataFrame) -> StreamingQuery:
        records = R.required_fields(M.decode(messages))
        return J.start_batch_indicators(records, J.folder_sink(out), progress, DAILY)

    take_parts(daily(spark, sf_dir), (F.col("trade_date") > STREAM_CUT).cast("int"), 2, start)
    rows = M.decode(J.read_folder_sink(spark, out), J.INDICATOR_SCHEMA)
    return rounded(rows)


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "enriched")
    state, progress = new_folder(spark, "state"), new_folder(spark, "progress")

    def start(messages: DataFrame) -> StreamingQuery:
        records = R.required_fields(M.decode(messages))
        return J.start_enriched_batches(records, out, state, progress, DAILY)

    take_parts(daily(spark, sf_dir), (F.col("trade_date") > STREAM_CUT).cast("int"), 2, start)
    return rounded(spark.read.schema(J.ENRICHED_SCHEMA).parquet(out).select(*OUT_ENRICHED))


def parted(bars: DataFrame, part: Column, staged: str | None = None) -> DataFrame:
    """The bars with their part, built once and stored by part: every task writes its own of
    each."""
    staged = staged or new_folder(bars.sparkSession, "parts")
    rows = bars.withColumn("part", part)
    rows.write.partitionBy("part").parquet(staged, compression="zstd")
    return bars.sparkSession.read.schema(rows.schema).parquet(staged)


def take_parts(
    bars: DataFrame, part: Column, parts: int, start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Write the messages part by part, and after each let the stream take what is new, which
    is one micro-batch. A start resumes from the checkpoint of the one before. Messages are
    packed; what was written as messages goes, and so do messages that were taken."""
    spark = bars.sparkSession
    staged, inbox = new_folder(spark, "parts"), new_folder(spark, "inbox")
    # A stream has the settings that are there when it starts.
    with no_shuffle_left(spark):
        rows = parted(bars, part, staged)
        for at in range(parts):
            messages = M.encode(rows.where(F.col("part") == at).drop("part"))
            M.write_folder(messages, inbox, compression="gzip", file_rows=M.FILE_ROWS)
            drop_folder(spark, f"{staged}/part={at}")
            start(M.folder_stream(spark, inbox)).awaitTermination()
            drop_folder(spark, inbox)
    drop_folder(spark, staged)


def arrival(cuts: tuple[str, ...]) -> Column:
    """The part a bar arrives in: by date, and one later for every fifth volume."""
    by_date = sum((F.col("trade_date") > cut).cast("int") for cut in cuts)
    return by_date + (F.pmod("vol", F.lit(5)) == 0).cast("int")


def stream_enriched_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches, in which a fifth of the bars comes after later bars."""
    out = new_folder(spark, "enriched")
    state, progress = new_folder(spark, "state"), new_folder(spark, "progress")

    def start(messages: DataFrame) -> StreamingQuery:
        records = R.required_fields(M.decode(messages))
        # The series are cut into yearly chunks, as a hot one would be.
        return J.start_enriched_batches(records, out, state, progress, YEARLY)

    take_parts(daily(spark, sf_dir, fields=NARROW), arrival(PACE_CUTS), len(PACE_CUTS) + 2, start)
    return rounded(spark.read.schema(J.ENRICHED_SCHEMA).parquet(out).select(*OUT_ENRICHED))


def stream_warm_start_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after an overlapping history."""
    out = new_folder(spark, "enriched")
    state, progress = new_folder(spark, "state"), new_folder(spark, "progress")
    history, live = history_and_live(spark, sf_dir)
    warm = J.table_state(history, DAILY)

    def start(messages: DataFrame) -> StreamingQuery:
        records = R.required_fields(M.decode(messages))
        return J.start_enriched_batches(records, out, state, progress, DAILY, warm)

    take_parts(live, arrival(WARM_PACE_CUTS), len(WARM_PACE_CUTS) + 2, start)
    return rounded(spark.read.schema(J.ENRICHED_SCHEMA).parquet(out).select(*OUT_ENRICHED))


def stream_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "enriched")
    state, progress = new_folder(spark, "state"), new_folder(spark, "progress")
    history, live = history_and_live(spark, sf_dir)
    M.write_folder(M.encode(live), inbox)
    records = R.required_fields(M.decode(M.folder_stream(spark, inbox)))
    J.start_enriched_batches(
        records, out, state, progress, DAILY, J.table_state(history, DAILY)
    ).awaitTermination()
    return rounded(spark.read.schema(J.ENRICHED_SCHEMA).parquet(out).select(*OUT_ENRICHED))


def stream_warm_start_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the state of each series in Spark's state store."""
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "enriched")
    history, live = history_and_live(spark, sf_dir)
    M.write_folder(M.encode(live), inbox)
    before = spark.conf.get(J.STATE_STORE_SETTING)
    spark.conf.set(J.STATE_STORE_SETTING, J.STATE_STORE)
    try:
        rows = J.enriched_stream(
            R.required_fields(M.decode(M.folder_stream(spark, inbox))),
            J.initial_state(history, DAILY),
        )
        J.append_to_folder(rows, out, new_folder(spark, "progress")).awaitTermination()
    finally:
        spark.conf.set(J.STATE_STORE_SETTING, before)
    return rounded(spark.read.schema(J.ENRICHED_SCHEMA).parquet(out).select(*OUT_ENRICHED))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches; every fifth bar comes again a part later, within the watermark's
    delay or after it."""
    out, progress = new_folder(spark, "distinct"), new_folder(spark, "progress")
    bars = daily(spark, sf_dir, fields=NARROW)
    by_date = sum((F.col("trade_date") > cut).cast("int") for cut in PACE_CUTS)
    times = F.when(F.pmod("vol", F.lit(5)) == 0, F.array(by_date, by_date + 1)).otherwise(F.array(by_date))
    twice = bars.withColumn("part", F.explode(times))
    schema = bars.select(*NARROW).schema

    def start(messages: DataFrame) -> StreamingQuery:
        distinct = IN.without_repeats(R.required_fields(M.decode(messages)), DEDUP_DELAY)
        return J.append_to_folder(distinct.select(*NARROW), out, progress)

    # Without batches of their own for the watermark: it moves with the parts only.
    before = spark.conf.get(EMPTY_BATCHES_SETTING)
    spark.conf.set(EMPTY_BATCHES_SETTING, "false")
    try:
        take_parts(twice, F.col("part"), len(PACE_CUTS) + 2, start)
    finally:
        spark.conf.set(EMPTY_BATCHES_SETTING, before)
    return rounded(spark.read.schema(schema).parquet(out))


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars as messages, some without a price and some no JSON."""
    case = F.pmod("vol", F.lit(7))
    prices = [F.when(case != i, F.col(c)).alias(c) for i, c in enumerate(("high", "low", "close"), 1)]
    text = F.to_json(F.struct(*KEY, *prices, "vol"))
    bars = daily(spark, sf_dir, fields=NARROW)
    return bars.select(F.when(case == 6, F.concat(F.lit("no "), text)).otherwise(text).alias("value"))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by what became of them, per series; unreadable ones belong to none."""
    inbox, progress = new_folder(spark, "inbox"), new_folder(spark, "progress")
    good, bad = new_folder(spark, "accepted"), new_folder(spark, "rejected")
    M.write_folder(faulty_messages(spark, sf_dir), inbox)
    # Two micro-batches, where there is more than one file.
    files = (len(spark.read.text(inbox).inputFiles()) + 1) // 2
    IN.start_intake(M.folder_stream(spark, inbox, files), good, bad, progress).awaitTermination()
    accepted = spark.read.schema(M.MESSAGE_SCHEMA).parquet(good).select(*KEY, F.lit("accepted").alias("reason"))
    rejected = M.parsed(spark.read.schema(IN.REJECT_SCHEMA).parquet(bad), keep_value=True)
    reasons = IN.with_reason(rejected.select("value")).select(*KEY, "reason")
    return accepted.unionByName(reasons)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars replayed in date order in `REPLAY_BATCHES` micro-batches, each a new
    start from the checkpoint."""
    folder, out = new_folder(spark, "replay"), new_folder(spark, "replayed")
    progress = new_folder(spark, "progress")
    n = RP.store_replay(daily(spark, sf_dir, fields=NARROW), folder)
    schema = RP.due_rows(spark, folder, 0, 0).schema

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for _ in range(REPLAY_BATCHES):
        RP.start_replay(
            spark, folder, keep, progress, rows_per_batch=n // REPLAY_BATCHES + 1
        ).awaitTermination()
    return rounded(spark.read.schema(schema).parquet(out).select(*schema.fieldNames()))


# -- stored history and SQL -----------------------------------------------------------


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history up to one date, then late and corrected rows from an earlier date on: the
    overlap comes with volumes raised by one."""
    folder = new_folder(spark, "history")
    history, live = history_and_live(spark, sf_dir)
    H.write_history(history, folder)
    H.upsert_history(spark, live.withColumn("vol", F.col("vol") + 1), folder)
    return rounded(H.look_up(spark, folder).select(*NARROW))


def sql_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily(spark, sf_dir, fields=NARROW).createOrReplaceTempView("candlewick_bars")
    SQL.register(spark)
    # One frame for all: a moving frame is collected anew for every row, a slice is not.
    frame = (
        "collect_list(struct(high, low, close)) OVER (PARTITION BY ts_code ORDER BY trade_date "
        "ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS moves"
    )
    last = ", ".join(
        f"slice(moves, greatest(size(moves) - {rows - 1}, 1), {rows}) AS {name}"
        for name, rows in (("range", 9), ("turns", 10))
    )
    return rounded(
        spark.sql(
            f"""SELECT ts_code, trade_date, rsi, kdj.k, kdj.d, kdj.j, psar FROM (
            SELECT ts_code, trade_date, rsi_of(moves, 14) AS rsi, kdj_of(range, 9) AS kdj,
                   psar_of(turns, 0.02D, 0.2D) AS psar
            FROM (SELECT ts_code, trade_date, moves, {last}
                  FROM (SELECT ts_code, trade_date, {frame} FROM candlewick_bars)))"""
        )
    )


def sql_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily(spark, sf_dir, fields=NARROW).createOrReplaceTempView("candlewick_bars")
    SQL.register(spark, "candlewick_bars")
    return rounded(
        spark.sql(
            """SELECT ts_code, n_bars, k, d, j, psar, obv
            FROM kdj_by_series(9) JOIN psar_by_series(0.02D, 0.2D) USING (ts_code) JOIN obv_by_series() USING (ts_code)"""
        )
    )


QUERIES: dict[str, Query] = {
    # scans and projections
    "bars_daily": over_daily(lambda b: b),
    "bars_hourly": over_hourly(lambda b: b),
    "bars_scan": bars_scan,
    "bars_page": over_daily(lambda b: scan_bars(b, offset=PAGE_OFFSET, limit=PAGE_LIMIT)),
    "bars_scan_code": bars_scan_code,
    "bars_on_date": bars_on_date,
    "history_scan": history_scan,
    "required_fields": required_fields,
    "volume_alias": volume_alias,
    "json_roundtrip": json_roundtrip,
    "json_props": json_props,
    # aggregates
    "bar_counts": over_daily(lambda b: A.bar_counts(b, DAILY), *KEY),
    "first_close": over_daily(lambda b: A.first_closes(b, DAILY), *CLOSE),
    "obv_total": over_daily(lambda b: A.volume_totals(b, DAILY), *KEY, "vol"),
    "kdj_agg": over_daily(lambda b: A.kdj_of_series(b, YEARLY), *PRICES),
    "psar_agg": over_daily(lambda b: A.psar_of_series(b, YEARLY), *PRICES),
    # windows
    "price_delta": over_daily(lambda b: W.price_delta(b, DAILY), *CLOSE),
    "avg_gain_loss": over_daily(lambda b: I.average_moves(b, DAILY), *CLOSE),
    "rolling_extremes": over_daily(
        lambda b: W.rolling_extremes(b, DAILY), *KEY, "high", "low"
    ),
    "obv_running": over_daily(lambda b: W.running_volume(b, DAILY), *KEY, "vol"),
    "last_k_bars": over_daily(lambda b: A.last_bars(b, LAST_K, DAILY), *NARROW),
    # indicators
    "rsi": over_daily(lambda b: I.rsi(b, DAILY), *CLOSE),
    "psar_step": over_daily(lambda b: I.step_psar(b, DAILY), *PRICES),
    "kdj_window": over_daily(lambda b: I.kdj(b, DAILY), *PRICES),
    "psar_window": over_daily(lambda b: I.psar(b, DAILY), *PRICES),
    "indicator_rows": over_daily(lambda b: R.indicator_rows(b, DAILY), *PRICES),
    "indicator_join": over_daily(lambda b: R.indicator_join(b, DAILY), *PRICES),
    "enriched_records": over_daily(lambda b: R.enriched_records(b, DAILY)),
    "all_indicators": over_daily(lambda b: R.all_indicators(b, DAILY), *NARROW),
    # the same over hourly bars in chunks with halo rows
    "indicator_rows_hourly": over_hourly(lambda b: R.indicator_rows(b, HOURLY), *PRICES),
    "enriched_records_hourly": over_hourly(lambda b: R.enriched_records(b, HOURLY)),
    "kdj_agg_hourly": over_hourly(lambda b: A.kdj_of_series(b, HOURLY), *PRICES),
    "psar_agg_hourly": over_hourly(lambda b: A.psar_of_series(b, HOURLY), *PRICES),
    "macd": over_daily(lambda b: to_cents(AV.macd(b, DAILY)), *CLOSE),
    "macd_hourly": over_hourly(lambda b: to_cents(AV.macd(b, HOURLY)), *CLOSE),
    # sets and views
    "history_live_union": history_live_union,
    "history_live_dedup": history_live_dedup,
    "latest_panel": over_daily(lambda b: V.latest_values(b, DAILY), *NARROW),
    "latest_panel_text": over_daily(
        lambda b: V.panel(rounded(V.latest_values(b, DAILY))), *NARROW
    ),
    "chart_series": over_daily(
        lambda b: V.chart_series(R.enriched_records(b, DAILY)), *NARROW
    ),
    # streams
    "stream_decode": stream_decode,
    "stream_batch_indicators": stream_batch_indicators,
    "stream_enriched": stream_enriched,
    "stream_enriched_paced": stream_enriched_paced,
    "stream_warm_start": stream_warm_start,
    "stream_warm_start_paced": stream_warm_start_paced,
    "stream_warm_start_store": stream_warm_start_store,
    "stream_dedup": stream_dedup,
    "stream_rejects": stream_rejects,
    "stream_replay": stream_replay,
    # the same from SQL
    "sql_indicators": sql_indicators,
    "sql_series": sql_series,
    # extensions
    "history_lookup": history_lookup,
    "history_upsert": history_upsert,
    "kdj_hit_rate": over_daily(lambda b: R.kdj_hit_rate(b, DAILY), *PRICES),
    "obv_close_corr": over_daily(lambda b: R.obv_close_corr(b, DAILY), *CLOSE, "vol"),
}
