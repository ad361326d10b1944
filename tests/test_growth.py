"""Steps whose cost must follow the input: parts written by all tasks, packed messages, values
computed once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick import queries as Q
from candlewick.functions import sql_forms as SQL
from candlewick.llm import digest_index
from candlewick.sources import messages as M
from candlewick.streaming.state import ROW_SCHEMA, RecentBars


def lineitem(spark, folder, n=4000):
    rows = spark.range(0, n, 1, 8).select(
        F.col("id").alias("l_orderkey"),
        (F.col("id") % 5).cast("int").alias("l_linenumber"),
        (F.col("id") % 31).alias("l_partkey"),
        (F.col("id") % 20).alias("l_suppkey"),
        F.col("id").cast("double").alias("l_quantity"),
        (F.col("id") + 0.5).cast("double").alias("l_extendedprice"),
        F.date_add(F.lit("1995-01-01"), (F.col("id") % 2400).cast("int")).alias("l_shipdate"),
    )
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_a_part_is_written_by_many_tasks(spark):
    bars = spark.range(0, 800, 1, 8).withColumn("vol", F.col("id") * 1.0)
    rows = Q.parted(bars, (F.col("id") % 2).cast("int"))
    assert len([f for f in rows.inputFiles() if "/part=1/" in f]) == 8
    assert rows.where("part = 1").count() == 400


def test_each_part_is_one_batch_even_an_empty_one(spark, tmp_path):
    batches = []

    def start(messages):
        return (
            messages.writeStream.foreachBatch(lambda rows, at: batches.append((at, rows.count())))
            .option("checkpointLocation", str(tmp_path / "p"))
            .trigger(availableNow=True)
            .start()
        )

    bars = spark.range(0, 30, 1, 4).select(F.col("id").cast("string").alias("ts_code"))
    Q.take_parts(bars, F.when(F.col("ts_code") == "0", 0).otherwise(2), 3, start)
    assert batches[0] == (0, 1) and batches[-1] == (2, 29)


def test_messages_are_not_dealt_to_a_few_tasks(spark, tmp_path, monkeypatch):
    sf = lineitem(spark, tmp_path / "sf")
    asked = []
    whole = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: asked.append(a) or whole(self, *a))
    reasons = {r.reason: r["count"] for r in Q.stream_rejects(spark, sf).groupBy("reason").count().collect()}
    assert sum(reasons.values()) == Q.daily(spark, sf).count() and len(reasons) == 5
    assert not asked


def test_decoded_messages_are_packed(spark, tmp_path, monkeypatch):
    sf = lineitem(spark, tmp_path / "sf")
    sizes = []
    write = M.write_folder

    def spy(messages, folder, *args, **options):
        write(messages, folder, *args, **options)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        sizes.append((found.agg(F.sum("length")).first()[0], messages.agg(F.sum(F.length("value") + 1)).first()[0]))

    monkeypatch.setattr(M, "write_folder", spy)
    assert Q.stream_decode(spark, sf).count() == Q.daily(spark, sf).count()
    assert sizes[0][0] < 0.5 * sizes[0][1]


def test_sql_functions_compute_their_aggregates_once(spark):
    SQL.register(spark)
    spark.range(1).select(
        F.array(F.struct(F.lit(3.0).alias("high"), F.lit(1.0).alias("low"), F.rand().alias("close"))).alias("bars")
    ).createOrReplaceTempView("growth_bars")

    def times(call):
        plan = spark.sql(f"SELECT {call} AS v FROM growth_bars")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("aggregate("), plan.count("zip_with(") + plan.count("transform(sequence")

    assert times("kdj_of(bars, 9)") == (1, 1)
    assert times("rsi_of(bars, 14)") == (2, 1)


class OneValue:
    """A value of which every access is counted."""

    def __init__(self):
        self.value, self.reads = None, 0

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value


def test_state_is_read_once_a_series_and_undated_bars_come_last():
    step = RecentBars()
    step._state = OneValue()
    dates = ["19990103", None, "19990101", "", "19990102"]
    bars = pd.DataFrame({c: pd.Series([None] * 5, dtype=float) for c in ROW_SCHEMA.fieldNames() if c not in ("n", "obv")})
    bars = bars.assign(ts_code="a", trade_date=dates, high=[3.0, 9.0, 1.0, 8.0, 2.0], counted=1.0)
    bars = bars[[c for c in bars.columns if not c.startswith("recent_")]]
    out = pd.concat(step.handleInputRows(("a",), iter([bars[:2], bars[2:]]), None))
    assert out["high"].tolist() == [1.0, 2.0, 3.0, 9.0, 8.0] and out["n"].tolist() == [1, 2, 3, 4, 5]
    assert out["obv"].tolist() == [1.0, 2.0, 3.0, 4.0, 5.0] and step._state.reads == 1
    assert out["recent_high"].iloc[-1].tolist() == [1.0, 2.0, 3.0, 9.0, 8.0] and step._state.value[0] == 5


def test_a_bucket_is_one_file_whatever_the_shuffle(spark, monkeypatch):
    """As on a cluster that raises the number of partitions of every keyed shuffle."""
    whole = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: whole(self, max(n, 40) if by else n, *by))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    before = set(t.name for t in spark.catalog.listTables())
    assert digest_index.exact_duplicates(docs, buckets=4).where("kept").count() == 300
    made = [t.name for t in spark.catalog.listTables() if t.name not in before and t.name.startswith("digest_index")]
    assert len(made) == 1 and len(spark.table(made[0]).inputFiles()) == 4
