"""Disk and driver memory: shuffle files, stored tables and messages go when they were used."""

from __future__ import annotations

import os
import time
import tracemalloc

from pyspark.sql import functions as F

import corpus_pipeline
from candlewick import queries as Q
from candlewick.llm import lines, shared
from candlewick.llm.sketch import passes, sketch_of
from candlewick.plans import scratch
from candlewick.streaming import jobs as J


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = (f.rsplit("/", 1)[-1] for f in blocks.getAllFiles().mkString("\n").split("\n"))
    return {f for f in names if f.startswith("shuffle_")}


def folders(spark):
    return set(os.listdir(scratch.shared_root(spark).removeprefix("file://").removeprefix("file:")))


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(scratch._CLEANUP, None)
    kept = shared.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "room")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(scratch._CLEANUP, None) == setting
    assert kept.count() == 7
    assert [f for f in folders(spark) if f.startswith("room-")]
    shared.dropped(kept, spark.range(1))
    assert not [f for f in folders(spark) if f.startswith("room-")]


def test_line_dedup_removes_what_it_stored_on_the_way(spark):
    before = folders(spark)
    words = [" ".join(f"w{i}{k}" for k in range(30)) for i in range(5)]
    rows = [(i, f"{w}\nshort line\n{w}x") for i, w in enumerate(words)]
    done = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {f.rsplit("-", 1)[0] for f in folders(spark) - before}
    gone = {"lines", "line-pairs", "line-many", "line-involved", "line-homes", "line-links", "line-roots", "line-twice"}
    assert not left & (gone | {"line-groups-edges"}) and "removed-lines" in left
    assert sorted(r.n_removed for r in done.collect()) == [1, 2, 2, 2, 2]


def test_the_pipeline_keeps_one_stage_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(10).write.parquet(str(tmp_path / "documents.parquet"))
    stages = [(f"room {k}", lambda s, d, _: d.select((F.col("id") + 1).alias("id"))) for k in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.id for r in found.collect()) == list(range(3, 13))
    assert [f.rsplit("-", 1)[0] for f in folders(spark) if f.startswith("pipeline-room")] == ["pipeline-room-2"]


def test_a_bitmap_comes_to_the_driver_without_rows(spark):
    ids = spark.range(300_000).select(F.xxhash64("id").alias("id")).persist()
    sketch_of(spark.range(10))
    tracemalloc.start()
    table = sketch_of(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Rows of all its words would take some 20 MB.
    assert most < 6e6
    assert passes(table.value, ids.toPandas()["id"].to_numpy()).all()


def lineitem(spark, folder, n=3000):
    rows = spark.range(0, n, 1, 4).select(
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


def test_messages_are_packed_and_go_when_they_were_taken(spark, tmp_path, monkeypatch):
    sf, before, taken = lineitem(spark, tmp_path / "sf"), folders(spark), []
    start = J.start_enriched_batches

    def seen(records, *args, **options):
        root = scratch.shared_root(spark).removeprefix("file://").removeprefix("file:")
        now = [f for f in folders(spark) - before if f.startswith(("inbox-", "parts-"))]
        taken.append([n for f in now for _, _, names in os.walk(f"{root}/{f}") for n in names if n.startswith("part-")])
        return start(records, *args, **options)

    monkeypatch.setattr(J, "start_enriched_batches", seen)
    assert Q.stream_enriched(spark, sf).count() == Q.daily(spark, sf).count()
    first, second = taken
    assert {n.rsplit(".", 1)[-1] for n in first} == {"gz", "parquet"}
    assert {n.rsplit(".", 1)[-1] for n in second} == {"gz"}
    assert not [f for f in folders(spark) - before if f.startswith(("inbox-", "parts-"))]


def test_indicator_messages_are_packed(spark, tmp_path):
    bars = spark.createDataFrame([("a",)], "value string")
    J.folder_sink(str(tmp_path))(bars, 0)
    names = [n for n in os.listdir(tmp_path / "batch=0") if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    assert [r.value for r in J.read_folder_sink(spark, str(tmp_path)).collect()] == ["a"]
