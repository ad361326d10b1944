"""Spelling variants by permuterm rotations.

A word with a terminator behind it is turned so that one of its letters comes last. What
stands before that letter is the word with the letter skipped: words that differ in it
share the prefix, and a word that lacks it has the prefix as a whole rotation. So all
rotations are sorted by prefix, and the groups of one prefix are scanned. A group holds
one word for each letter of the alphabet at most, and one that lacks the letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.resampling import CRC_SQL, crc_sql
from candlewick.llm.shared import in_arrow, in_order, stored

LEAST_LETTERS = 5
LEAST_COUNT = 3
# A form is at least so many times as frequent as its variant.
TIMES = 2
# One in so many different words of a document loses a letter; 0 for none.
SLIP = 97
TERMINATOR = "$"
# Prefixes of more letters are represented by a digest of about 120 bits.
LONGEST_KEY = 64
# Different words held before they are handed on, and rotations handed on together.
HELD = 1 << 18
AT_ONCE = 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PRIMES = ((1 << 61) - 1, (1 << 59) - 55)
_BASE = 0x2545F4914F6CDD1D


def slipped(run: str, start: int, every: int = SLIP) -> str:
    """A run as it is counted: without one letter if `every` divides the checksum of the
    document's id, a colon and the run. `start` is the checksum up to the colon."""
    h = zlib.crc32(run.encode(), start)
    if not every or h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(least: int, every: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            arrays = [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(len(texts)):
                text = texts[i].as_buffer().to_pybytes().translate(_LOWER).decode()
                start = zlib.crc32(f"{ids[i].as_py()}:".encode())
                for run, n in Counter(map(re.Match.group, runs.finditer(text))).items():
                    word = slipped(run, start, every)
                    if len(word) >= least:
                        found[word] += n
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        yield out()

    return count


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, every: int = SLIP) -> DataFrame:
    """`word, n` over all texts. Each task adds up its words before the shuffle."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    parts = in_arrow(rows, _counter(least, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class _Digest:
    """Digests of strings put together from a tail of a word, the terminator and a head."""

    def __init__(self, word: str) -> None:
        self.sums, self.powers = [], []
        for p in _PRIMES:
            total, power, sums, powers = 0, 1, [0], [1]
            for letter in word:
                total = (total * _BASE + ord(letter)) % p
                power = power * _BASE % p
                sums.append(total)
                powers.append(power)
            self.sums.append(sums)
            self.powers.append(powers)
        self.length = len(word)

    def turned(self, tail: int, head: int) -> str:
        """Digest of word[tail:] + terminator + word[:head]."""
        parts = []
        for p, sums, powers in zip(_PRIMES, self.sums, self.powers, strict=True):
            rest = (sums[-1] - sums[tail] * powers[self.length - tail]) % p
            parts.append(((rest * _BASE + ord(TERMINATOR)) * powers[head] + sums[head]) % p)
        return f"#{self.length - tail + 1 + head}:{parts[0]:x}:{parts[1]:x}"


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(key, skips, first) for every rotation of the marked word.

    `skips`: the key is the rotation without its last letter, else the whole rotation.
    `first`: the skipped letter differs from the one before it. Taking away any letter of
    a run of equal ones gives the same word, so only the first of a run counts as that.
    """
    n = len(word)
    turned = word + TERMINATOR + word
    digest = _Digest(word) if n >= LONGEST_KEY else None
    for at in range(n):
        key = turned[at + 1 : at + 1 + n] if n <= LONGEST_KEY else digest.turned(at + 1, at)
        yield key, True, at == 0 or word[at] != word[at - 1]
    for at in range(n + 1):
        yield turned[at : at + n + 1] if n < LONGEST_KEY else digest.turned(at, at), False, True


def _rotator(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[str] = []
    marks: list[tuple[bool, bool, int, int]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*marks, strict=True)) or [[]] * 4
        kinds = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        arrays = [pa.array(keys, pa.string())]
        arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "skips", "first", "id", "n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("word", "id", "n")]
        for word, at, n in zip(*columns, strict=True):
            for key, skips, first in rotations(word):
                keys.append(key)
                marks.append((skips, first, at, n))
                if len(keys) >= AT_ONCE:
                    yield out()
                    keys, marks = [], []
    yield out()


def scan_group(members: list[tuple[bool, bool, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, near words, largest n among them, its id) for the members of one prefix.

    Members that skip the letter are all near each other; the word without the letter is
    near those whose skipped letter is the first of its run.
    """

    def best(some: list[tuple[int, int]]) -> tuple[int, int]:
        return max(some, key=lambda x: (x[0], -x[1]))

    skipping = [(n, i) for skips, _, i, n in members if skips]
    lacking = [(n, i) for skips, _, i, n in members if not skips]
    shorter = [(n, i) for skips, first, i, n in members if skips and first]
    if lacking and shorter:
        yield lacking[0][1], len(shorter), *best(shorter)
    top = best(skipping) if skipping else None
    second = best([x for x in skipping if x != top]) if len(skipping) > 1 else None
    for skips, first, i, n in members:
        if not skips:
            continue
        near = len(skipping) - 1 + (len(lacking) if first else 0)
        if near:
            other = [second if (n, i) == top else top] if len(skipping) > 1 else []
            yield i, near, *best(other + (lacking if first else []))


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans sorted rotations; a group that goes on in the next batch waits for it."""
    rest = None

    def scanned(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("key").combine_chunks()
        differs = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.r_[0, np.flatnonzero(differs) + 1, len(keys)]
        columns = [rows.column(c).to_numpy() for c in ("skips", "first", "id", "n")]
        found = []
        for group in np.flatnonzero(np.diff(starts) > 1):
            low, high = starts[group], starts[group + 1]
            found += scan_group(list(zip(*(c[low:high].tolist() for c in columns), strict=True)))
        parts = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int64()) for p in parts], names=["id", "n_near", "form_n", "form_id"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        keys = rows.column("key")
        last = pc.index(pc.equal(keys, keys[-1]), True).as_py()
        rest = rows.slice(last)
        if last:
            yield scanned(rows.slice(0, last))
    if rest is not None:
        yield scanned(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """`id, n_near, form_n, form_id` of the words that have a near one; `form_id` is the near
    word of largest n, then of smallest id. Needs `word, id, n`, words different."""
    turned = in_arrow(words.select("word", "id", "n"), _rotator, "key string, skips boolean, first boolean, id long, n long")
    ordered = turned.repartitionByRange("key").sortWithinPartitions("key")
    found = in_arrow(ordered, _scanner, "id long, n_near long, form_n long, form_id long")
    best = F.max(F.struct("form_n", (-F.col("form_id")).alias("down"))).alias("best")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select(
        "id", "n_near", "best.form_n", (-F.col("best.down")).alias("form_id")
    )


def roots_of(steps: DataFrame) -> DataFrame:
    """`id, root_id`: where following `id, form_id` steps ends. Every round doubles the
    distance, and n doubles with every step, so there are few rounds."""
    reach = stored(steps.select("id", F.col("form_id").alias("root_id")), "spelling-roots")
    while True:
        onward = reach.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        joined = reach.join(onward, "root_id", "left")
        joined = joined.select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved"))
        joined = stored(joined, "spelling-roots")
        reach = joined.select("id", "root_id")
        if joined.where("moved").isEmpty():
            return reach


def variants(
    docs: DataFrame,
    least: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    every: int = SLIP,
) -> DataFrame:
    """`word, n, form, form_n, root, n_near` of every word of all texts that has at least
    `least` letters and `least_count` occurrences.

    `n_near` counts the words one inserted, deleted or replaced letter away. `form` is the
    most frequent of them (ties: first in code-point order) if it occurs `times` as often,
    else null; `root` is where following forms ends.

    - A null text has no words; a null doc_id counts as an empty one.
    - Repeated rows count as often as they are there. An empty table gives no rows.
    - Very long words are handled like others: their rotations are held as digests.
    - Other columns of `docs` are not read.
    """
    counted = word_counts(docs, least, every).where(F.col("n") >= least_count)
    words = in_order(counted, ["word"], F.lit(1).cast("long"), "spelling-words")
    words = stored(words.withColumnRenamed("before", "id"), "spelling-ids")
    near = stored(neighbours(words), "spelling-near")
    # Few words have a form, and what is joined from here on is a few numbers a word.
    formed = near.join(words.select("id", "n"), "id").where(F.col("form_n") >= times * F.col("n"))
    steps = stored(formed.select("id", "form_id", "form_n"), "spelling-forms")
    linked = steps.join(roots_of(steps), "id")
    form = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = linked.join(form, "form_id").join(root, "root_id").select("id", "form", "form_n", "root")
    rows = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return rows.select(
        "word",
        "n",
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL}
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc_table),
slips AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
              ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= {LEAST_LETTERS}
  GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM skips a JOIN skips b
    ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON b.word = a.head || a.tail),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, first(near ORDER BY n DESC, near) AS form FROM pairs GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.root
FROM formed f JOIN walk USING (word) JOIN formed e ON e.word = walk.root WHERE e.form IS NULL
"""
