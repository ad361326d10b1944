"""WARC archives of pages, and one index of all captures merged from their sorted runs."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.shared import in_arrow, stored
from candlewick.plans.scratch import new_folder

# Every record ends with two line ends: this is also how the text writer parts its rows.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
RECORDS_PER_ARCHIVE = 1000


def url_key(url: Column) -> Column:
    """Sort key of a URL: host parts in reverse, then path and query; lower-case host,
    no scheme, user, default port or fragment. Null for a null URL."""
    bare = F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^.*@|:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_time(page_id: Column) -> Column:
    """Pages carry no time: a capture is taken `page_id` seconds after 2020-01-01 UTC."""
    second = F.coalesce(page_id, F.lit(0))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    rest = F.pmod(second, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z"))


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One WARC record per page as text without its end, and the keys it is sorted by.

    Of equal payloads of at least `least` bytes the page with the largest page_id is a
    response and the others refer to it; repeated rows of that page are responses all.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # A line end inside a header would start another one.
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload).alias("digest"),
    )
    repeated = (
        rows.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1 and keep is not null")
        .select("digest", "keep")
    )
    rows = rows.join(stored(repeated, "payloads"), "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    date = capture_time(F.col("page_id"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keep").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(
        F.concat(head, body).alias("value"), url_key(F.col("url")).alias("url_key"), date.alias("date"), "page_id"
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write gzip-compressed archives whose records are sorted by URL key and date.

    Goes through Spark's own committed output, so a lost executor leaves no half archive,
    and `path` may be any store Spark can write.
    """
    (
        records(pages, least)
        .sortWithinPartitions("url_key", "date", "page_id")
        .select("value")
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_archive)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of the records of one uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, at, stop + 4 - at, data[start:stop]
        at = stop + 4


def _page(name: str | None) -> int | None:
    value = name[len("<urn:page:") : -1] if name else "null"
    return None if value == "null" else int(value)


_CAPTURES = (
    ("archive", "string", pa.string()),
    ("seq", "long", pa.int64()),
    ("record_offset", "long", pa.int64()),
    ("record_length", "long", pa.int64()),
    ("page_id", "long", pa.int64()),
    ("url", "string", pa.string()),
    ("timestamp", "string", pa.string()),
    ("record_type", "string", pa.string()),
    ("refers_to", "long", pa.int64()),
    ("payload_bytes", "long", pa.int64()),
    ("payload_digest", "string", pa.string()),
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, kind) for name, _, kind in _CAPTURES])
    for batch in batches:
        for i, path in enumerate(batch.column("path").to_pylist()):
            rows = []
            data = gzip.decompress(batch.column("content")[i].as_py())
            for seq, (head, offset, length, block) in enumerate(parse_records(data)):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if head["WARC-Type"] == "response":
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                rows.append(
                    (
                        path.rpartition("/")[2],
                        seq,
                        offset,
                        length,
                        _page(head["WARC-Record-ID"]),
                        head.get("WARC-Target-URI"),
                        head["WARC-Date"],
                        head["WARC-Type"],
                        _page(head.get("WARC-Refers-To")),
                        size,
                        digest,
                    )
                )
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives in a folder, in file order within an archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _CAPTURES)
    captures = in_arrow(files.select("path", "content"), _read, schema)
    return captures.withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge of sorted runs: a match is replayed only on the winner's path."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        k = len(runs)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            left, right = winners[2 * node], winners[2 * node + 1]
            win, lose = (left, right) if self._first(left, right) else (right, left)
            winners[node], self.losers[node] = win, lose
        self.winner = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; a finished run goes last, ties by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + len(self.runs)) // 2
            while node:
                if self._first(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one range. Rows come grouped by archive, each in its own order."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return
    archives = table.column("archive").to_pylist()
    keys = list(
        zip(
            [(k is not None, k or "") for k in table.column("url_key").to_pylist()],
            table.column("timestamp").to_pylist(),
            range(table.num_rows),
            strict=True,
        )
    )
    cuts = [i for i in range(len(archives)) if not i or archives[i] != archives[i - 1]]
    runs = [iter(keys[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
    order = pa.array([row for _, _, row in LoserTree(runs)], pa.int64())
    table = table.take(order).append_column("position", pa.array(range(len(order)), pa.int64()))
    yield from table.to_batches()


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures in global order of URL key and timestamp.

    Each archive is a sorted run. The runs are cut at the same split points of (URL key,
    timestamp), so the captures of one URL may lie in several ranges; each range is merged
    by a loser tree over its part of every run. A row's place is (`range_id`, `position`).
    """
    kept = stored(captures, "captures")
    ranges = kept.repartitionByRange("url_key", "timestamp", "page_id")
    runs = ranges.withColumn("range_id", F.spark_partition_id()).sortWithinPartitions("archive", "seq")
    schema = T.StructType([*runs.schema.fields, T.StructField("position", T.LongType())])
    return in_arrow(runs, _merged, schema)


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages as WARC records, read the archives back and merge their index.

    - Null html is an empty payload; a null URL is left out and sorts first; null page_ids
      are recorded as such.
    - Repeated rows give repeated records. An empty table gives no archives and no rows.
    - Other columns of `pages` are not read.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, least)
    return merge_index(read_archives(spark, path))
