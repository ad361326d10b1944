"""Context-triggered piecewise hashing: fingerprints that survive local edits.

A rolling hash over seven bytes cuts a text into chunks; every chunk gives one of 64
letters. The block size is the smallest for which at most 64 letters are needed, so a
signature always stands for the whole text. A fingerprint is
`block size:letters:letters at twice the block size`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
SMALLEST = 3
LETTERS = 64
# Signatures without a common run of so many letters have nothing in common.
SHARED_RUN = 7
_FACTOR = 0x9E3779B1
_INVERSE = pow(_FACTOR, -1, 1 << 32)
_powers = {f: np.ones(1, np.uint32) for f in (_FACTOR, _INVERSE)}
_LETTER = np.frombuffer(ALPHABET.encode(), np.uint8)


def _table(factor: int, n: int) -> np.ndarray:
    """Powers of an odd factor modulo 2^32."""
    if len(_powers[factor]) < n:
        steps = np.full(max(n, 2 * len(_powers[factor])), factor, np.uint32)
        steps[0] = 1
        _powers[factor] = np.cumprod(steps, dtype=np.uint32)
    return _powers[factor]


def _rolling(data: np.ndarray) -> np.ndarray:
    """Sum, weighted sum and shifted exclusive-or of the last seven bytes, added up."""
    n = len(data)
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = data
    total = np.zeros(n, np.uint32)
    mixed = np.zeros(n, np.uint32)
    for back in range(WINDOW):
        byte = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += byte * np.uint32(WINDOW - back + 1)
        mixed ^= byte << np.uint32(5 * back)
    return total + mixed


def _letters(ends: np.ndarray, sums: np.ndarray) -> str:
    """One letter per chunk from differences of a running polynomial sum."""
    starts = np.concatenate(([0], ends[:-1]))
    hashed = (sums[ends] - sums[starts]) * _table(_INVERSE, len(sums))[starts]
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x85EBCA6B)
    return _LETTER[hashed >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    rolled = _rolling(data) + np.uint32(1)
    at = np.flatnonzero(rolled % np.uint32(SMALLEST) == 0)
    # A boundary at block size 3 * 2^k is one at every smaller size, too.
    parts = (rolled[at] // np.uint32(SMALLEST)).astype(np.int64)
    parts[parts == 0] = 1 << 30
    size = 0
    while len(at) >= LETTERS:
        stay = parts & 1 == 0
        at, parts, size = at[stay], parts[stay] >> 1, size + 1
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((data + np.uint32(1)) * _table(_FACTOR, n)[:n], dtype=np.uint32, out=sums[1:])
    coarse = at[parts & 1 == 0]

    def signature(cuts: np.ndarray) -> str:
        ends = cuts + 1
        return _letters(ends if len(ends) and ends[-1] == n else np.append(ends, n), sums)

    return f"{SMALLEST << size}:{signature(at)}:{signature(coarse)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 letters at a time in one integer."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        met = row & places.get(letter, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    run = min(SHARED_RUN, len(a), len(b))
    if not run:
        return 0.0
    seen = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in seen for i in range(len(b) - run + 1)):
        return 0.0
    # Insertions and deletions needed, against the most there can be.
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(left: str, right: str) -> float:
    """0 to 1 by edit distance; 0 where block sizes differ by more than a factor of two."""
    if left == right:
        return 1.0
    size, fine, coarse = left.split(":")
    size2, fine2, coarse2 = right.split(":")
    size, size2 = int(size), int(size2)
    if size == size2:
        return max(_like(fine, fine2), _like(coarse, coarse2))
    if size == 2 * size2:
        return _like(fine, coarse2)
    if size2 == 2 * size:
        return _like(coarse, fine2)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each followed by its next document; guests only follow."""
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    held = None
    for batch in batches:
        rows = []
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for i, guest in enumerate(batch.column("guest").to_pylist()):
            text = texts[i].as_py()
            own = fingerprint(text)
            if held:
                last_id, last, last_own = held
                changed = edited(last, text)
                print_ = last_own if changed == last else fingerprint(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append(
                    (
                        last_id,
                        len(last),
                        digest,
                        last_own,
                        print_,
                        likeness(last_own, print_),
                        likeness(last_own, own),
                    )
                )
            held = None if guest else (ids[i], text, own)
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema
        )


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The next document is the one with the next smaller doc_id; after the last comes the
    first. Returns the columns of `SCHEMA`.

    - A null text counts as empty; an empty text has no letters.
    - A null doc_id comes last; rows with the same doc_id are ordered by text.
    - A single document is its own next one. An empty table gives no rows.
    - Other columns of `docs` are not read.

    Texts are moved once: ranges of doc_id are cut first, from the ids alone, and the
    first document of each range is sent to the end of the range before, too.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (-F.coalesce(F.col("doc_id").cast("long"), F.lit(least + 1))).alias("place"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        rows.select("place")
        .repartitionByRange(parts, "place")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("place").alias("first"))
        .orderBy("first")
    )
    # One number per range, not per document.
    firsts = np.array([r["first"] for r in ranges.select("first").collect()], np.int64)
    n = len(firsts)
    if not n:
        return spark.createDataFrame([], SCHEMA)

    @F.pandas_udf("array<struct<part:int,guest:boolean>>")
    def parts_of(place: pd.Series) -> pd.Series:
        part = np.searchsorted(firsts, place.to_numpy(), side="right") - 1
        first = firsts[part] == place.to_numpy()
        return pd.Series(
            [
                [{"part": int(p), "guest": False}, {"part": int(p - 1) % n, "guest": True}]
                if f
                else [{"part": int(p), "guest": False}]
                for p, f in zip(part, first, strict=True)
            ]
        )

    spread = rows.withColumn("to", F.explode(parts_of("place"))).select(
        "doc_id", "text", "place", "to.part", "to.guest"
    )
    ordered = spread.repartition(parts, "part").sortWithinPartitions("part", "guest", "place", "text")
    return in_arrow(ordered.select("doc_id", "text", "guest"), _compared, SCHEMA)
