"""Importance resampling towards a target text: hashed n-gram buckets, log ratios, Gumbel draws.

The texts of a block are joined with a separator byte between them; one regex pass finds
the words of all of them, a binary search over the texts' offsets tells whose each word is,
n-grams that would reach into the next text are masked, and the rest is counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow, in_order, stored

BUCKETS = 10_000
RUNS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Bytes of text that are joined; a longer text is a block of its own.
BLOCK = 1 << 20
SEPARATOR = b"\x00"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in blocks of about `BLOCK` bytes, with the place of the first."""
    first, block, size = 0, [], 0
    for i in range(len(texts)):
        block.append(texts[i].as_buffer().to_pybytes())
        size += len(block[-1])
        if size >= BLOCK:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block


def features(block: list[bytes], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a block, and text and bucket of each n-gram of 1 to `runs` words."""
    joined = SEPARATOR.join(block).translate(_LOWER)
    ends = np.cumsum([len(text) + 1 for text in block])
    found = list(_WORD.finditer(joined))
    starts = np.fromiter((m.start() for m in found), np.int64, len(found))
    words = [m[0] for m in found]
    text = np.searchsorted(ends, starts, side="right")
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    of, bucket = [text], [crc % buckets]
    for more in range(1, runs):
        # The checksum of a longer n-gram goes on from that of the shorter one.
        later = (b" " + w for w in words[more:])
        crc = np.fromiter(map(zlib.crc32, later, crc[: len(words) - more].tolist()), np.int64)
        same = text[: len(crc)] == text[more:]
        of.append(text[: len(crc)][same])
        bucket.append(crc[same] % buckets)
    return np.bincount(text, minlength=len(block)), np.concatenate(of), np.concatenate(bucket)


def _counter(runs: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column("text")):
                total += np.bincount(features(block, runs, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return count


def _text() -> F.Column:
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. One number per bucket and task
    is shuffled, and one per bucket comes to the driver, whatever the size of the table."""
    parts = in_arrow(docs.select(_text()), _counter(runs, buckets), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source shares, by bucket."""
    k = len(source)
    source_all, target_all = float(source.sum() + k), float(target.sum() + k)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    ratios = ((t + 1.0) * source_all / ((s + 1.0) * target_all) for s, t in pairs)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weigher(gain: np.ndarray, runs: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((3, batch.num_rows), np.int64)
            for first, block in blocks(batch.column("text")):
                words, text, bucket = features(block, runs, len(gain))
                n = np.bincount(text, minlength=len(block))
                # Sums of whole numbers far below 2^53 are exact in doubles.
                sums = np.bincount(text, weights=gain[bucket], minlength=len(block)).astype(np.int64)
                counts[:, first : first + len(block)] = words, n, sums // np.maximum(n, 1)
            arrays = [batch.column("row"), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_features", "weight"])

    return weigh


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], runs: int = RUNS) -> DataFrame:
    """`row` (a struct of the kept columns), `n_words`, `n_features`, `weight` of every row.

    `weight` is the mean gain of the text's features, rounded down; 0 without any.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _text())
    kind = rows.schema["row"].dataType.simpleString()
    return in_arrow(rows, _weigher(gain, runs), f"row {kind}, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Add `score`: the weight plus thousandths of a Gumbel draw made from seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", (F.col("weight") + draw).cast("long"))


def _scored(docs: DataFrame, target: DataFrame, keep: list[str], runs: int, buckets: int, seed: int) -> DataFrame:
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    return with_score(weighed(docs, gain, keep, runs), seed)


def ranked(
    docs: DataFrame,
    target: DataFrame,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """`doc_id, n_words, n_features, weight, score, rank` of every row of `docs`.

    `rank` counts the drawn rows from 1 by falling score, then doc_id; it is null for the
    others. Drawn are the first `percent` of a hundred among the rows of `least_words`
    words or more, rounded down. Taking the highest scores draws without replacement in
    proportion to the exponentiated weights.

    - A null or wordless text has no features, weight 0, and is not drawn.
    - A null doc_id draws as an empty one and comes last among ties. Rows that repeat a
      doc_id share its draw; each counts by itself.
    - An empty table gives no rows; an empty target makes all target shares equal.
    - Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = _scored(rows, target, ["doc_id"], runs, buckets, seed)
    scored = stored(scored.select("row.doc_id", "n_words", "n_features", "weight", "score"), "scores")
    fit = F.col("n_words") >= least_words
    most = percent * scored.where(fit).count() // 100
    ordered = scored.withColumns(
        {"_short": ~fit, "_down": -F.col("score"), "_no_id": F.col("doc_id").isNull()}
    )
    order = ["_short", "_down", "_no_id", "doc_id", "weight", "n_features", "n_words"]
    placed = in_order(ordered, order, F.lit(1).cast("long"), "score-order")
    rank = F.when(fit & (F.col("before") < most), F.col("before") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows of `docs`, with their columns as they are.

    Every row decides by itself against the last drawn one; rows that share its score and
    doc_id come along.
    """
    ranks = ranked(docs, target, runs, buckets, least_words, percent, seed)
    last = ranks.where("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first().last
    if last is None:
        return docs.limit(0)
    scored = _scored(docs, target, docs.columns, runs, buckets, seed)
    own = F.col("row.doc_id").cast("long")
    no_later = F.lit(True) if last.doc_id is None else F.coalesce(own <= last.doc_id, F.lit(False))
    within = (F.col("score") > last.score) | ((F.col("score") == last.score) & no_later)
    return scored.where((F.col("n_words") >= least_words) & within).select("row.*")


# Words, checksums and draws in DuckDB; the checksum goes byte by byte over a table of 256.
CRC_SQL = """
crc_steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a string; needs `crc_table` in reach as column `t`."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {octets}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL}
words AS (
  SELECT id, own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark)),
tokens AS (SELECT id, own, word, count(*) AS n FROM words GROUP BY ALL),
spelt AS (SELECT word, {crc_sql('word')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM tokens), crc_table),
filled AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t
  FROM tokens JOIN spelt USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM filled) + {BUCKETS})
         / ((s + 1) * ((SELECT sum(t) FROM filled) + {BUCKETS}))))::BIGINT AS gain FROM filled),
weights AS (
  SELECT id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM tokens JOIN spelt USING (word) JOIN gains USING (bucket) WHERE own GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
         floor({PERCENT} * count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) / 100) AS most FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= most THEN place END AS rank
FROM placed
"""
