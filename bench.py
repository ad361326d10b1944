"""Times the registered queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick.queries import QUERIES  # noqa: E402
from candlewick.streaming.pace import PACE_SCHEMA, PaceLog  # noqa: E402

WARM_UP = "enriched_records"
# How often each query runs; the median counts.
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("candlewick-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        # Every column of every row is computed; nothing returns to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    def paced(rows: list[tuple]) -> dict[str, float]:
        """Rate and slowest batch of a stream, from its progress reports."""
        found = [dict(zip(PACE_SCHEMA.fieldNames(), row, strict=True)) for row in rows]
        busy = [r for r in found if r["n_rows"]]
        took = sum(r["seconds"] for r in busy)
        return {
            "rows_per_second": round(sum(r["n_rows"] for r in busy) / took, 1) if took else 0.0,
            "slowest_batch_sec": max((r["seconds"] for r in busy), default=0.0),
            "batches": len(busy),
        }

    log = PaceLog(spark, "")
    spark.streams.addListener(log)
    run(WARM_UP)
    seconds, streams = {}, {}
    for name in names:
        seconds[name] = statistics.median(run(name) for _ in range(RUNS))
        if rows := log.take():
            streams[name] = paced(rows)
    spark.streams.removeListener(log)
    print(
        json.dumps(
            {
                "metric": "registered queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "streams": streams,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
