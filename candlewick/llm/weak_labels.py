"""Quality from weak labels: heuristic labellers weighed by EM teach a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow, stored

FEATURES = 1 << 14
# Rows the scorer is fitted on.
TRAINING_ROWS = 4000
EPOCHS = 10
RATE = 2.0
SHRINK = 1e-5
SEED = 11
# Both classes weigh the same in training, so even odds would reject too many good ones.
LEAST_SCORE = 0.3
ROUNDS = 200
_SYMBOLS = b"#$%&*|~^<>{}\\@"


def _vote(value: float, bad: float, good: float) -> int:
    """-1 beyond `bad`, 1 beyond `good`, else no vote."""
    if bad > good:
        return -1 if value >= bad else int(value <= good)
    return -1 if value <= bad else int(value >= good)


def votes(text: str) -> tuple[int, ...]:
    """Votes of all labellers on a whole text: 1 good, -1 bad, 0 none. The labellers
    overlap; how far each is right is not assumed but estimated."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return -1, *[0] * (LABELLERS - 1)
    data = text.encode("utf-8", "replace")
    letters = len(data) - len(data.translate(None, _SYMBOLS))
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sizes = list(map(len, words))
    lines = text.split("\n")
    return (
        _vote(n, 5, 20),
        _vote(letters / n, 0.2, 0.02),
        _vote(sum(len(w) <= 3 and w.isalpha() for w in words) / n, 0.12, 0.25) if n >= 20 else 0,
        _vote(again / n, 0.1, 0.02) if n >= 20 else 0,
        _vote(max(counts.values()) / n, 0.25, 0.12) if n >= 20 else 0,
        _vote(sum(map(text.count, ".!?")) / n, 0.01, 0.03) if n >= 20 else 0,
        _vote(sum(sizes) / n, 9.0, 7.0),
        _vote(sum(c.isdigit() for c in data.decode("ascii", "ignore")) / len(data), 0.2, 0.02),
        _vote(len(set(lines)) / len(lines), 0.6, 0.95) if len(lines) >= 4 else 0,
    )


LABELLERS = 9


def pattern(found: tuple[int, ...]) -> int:
    """Votes as one number in base three."""
    code = 0
    for vote in found:
        code = code * 3 + vote + 1
    return code


def unpacked(codes: np.ndarray) -> np.ndarray:
    powers = 3 ** np.arange(LABELLERS - 1, -1, -1)
    return codes[:, None] // powers % 3 - 1


@dataclass(frozen=True)
class Labels:
    """Estimated share of good documents, and how each labeller votes on either class."""

    prior: float
    rates: np.ndarray  # labeller, class (bad, good), vote where there is one (bad, good)

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """Probability of good, of vote rows. Where a labeller does not vote it says nothing."""
        log = np.log(self.rates)
        each = (found == -1) @ log[:, :, 0] + (found == 1) @ log[:, :, 1]
        each += np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(each[:, 0] - each[:, 1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        return self.prior * self.rates[:, 1, 1] + (1 - self.prior) * self.rates[:, 0, 0]


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Labels:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Starts from the majority, and from labellers held to be right more often than not;
    every rate keeps a small count, so that none becomes certain.
    """
    found = unpacked(codes)
    good = np.clip(0.5 + found.sum(axis=1) / (2 * LABELLERS), 0.05, 0.95)
    labels = None
    for _ in range(rounds):
        weights = np.stack([(1 - good) * counts, good * counts])
        total = weights.sum()
        prior = float(np.clip(weights[1].sum() / max(total, 1), 0.01, 0.99))
        rates = np.stack([(weights @ (found == vote)).T for vote in (-1, 1)], axis=2)
        rates += 1.0 + 1e-4 * total
        rates[:, 0, 0] += 1.0
        rates[:, 1, 1] += 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        labels = Labels(prior, rates)
        after = labels.posterior(found)
        if np.abs(after - good).max(initial=0) < 1e-9:
            break
        good = after
    return labels


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams and word repeats of a whole text, scaled to length 1."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    if len(data) >= 3:
        gram = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        counts += np.bincount(gram * np.uint32(0x9E3779B1) >> shift, minlength=FEATURES)
    words = text.lower().split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    rare = len(set(words))
    counts = np.sqrt(counts)
    counts[0] += np.sqrt(3 * again)
    counts[1] += np.sqrt(max(0, len(words) - rare))
    at = np.flatnonzero(counts)
    value = counts[at]
    return at, value / np.sqrt((value * value).sum())


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(value @ self.weights[at] + self.bias, -500, 500))))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> Scorer:
    """Logistic regression on posterior labels by stochastic gradient descent. Both classes
    together weigh the same."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not rows:
        return Scorer(weights, bias)
    good = np.array([r[0] for r in rows])
    share = float(np.clip(good.mean(), 0.01, 0.99))
    draw = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for i in draw.permutation(len(rows)):
            label, at, value = rows[i]
            p = 1 / (1 + np.exp(-np.clip(value @ weights[at] + bias, -500, 500)))
            push = rate * (label * (1 - p) * 0.5 / share - (1 - label) * p * 0.5 / (1 - share))
            weights[at] += push * value - rate * SHRINK * weights[at]
            bias += 0.1 * push
    return Scorer(weights, bias)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        codes = [pattern(votes(texts[i].as_py())) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), pa.array(codes, pa.int64())], names=["draw", "pattern"]
        )


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(pattern(votes(t)), *features(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("draw"),
                pa.array([m[0] for m in made], pa.int64()),
                pa.array([m[1].astype("<u2").tobytes() for m in made], pa.binary()),
                pa.array([m[2].astype("<f4").tobytes() for m in made], pa.binary()),
            ],
            names=["draw", "pattern", "at", "value"],
        )


def _scorer(scorer: Scorer, labels: Labels):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column("text")[i].as_py() for i in range(batch.num_rows)]
            codes = np.array([pattern(votes(t)) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(codes),
                    pa.array(labels.posterior(unpacked(codes))),
                    pa.array([scorer.score(t) for t in texts], pa.float64()),
                ],
                names=["doc_id", "pattern", "posterior", "score"],
            )

    return score


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("draw"),
    )


def train(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> tuple[Scorer, Labels]:
    """Vote counts cover all rows: at most 3^9 patterns come to the driver. The scorer is
    fitted on the `training_rows` documents of the lowest hash, each as a whole."""
    rows = _rows(docs)
    voted = stored(in_arrow(rows.select("draw", "text"), _voted, "draw long, pattern long"), "votes")
    patterns = voted.groupBy("pattern").count().orderBy("pattern").toPandas()
    labels = estimate(patterns["pattern"].to_numpy(np.int64), patterns["count"].to_numpy(float))
    lowest = voted.select("draw").distinct().orderBy("draw").limit(training_rows)
    last = lowest.agg(F.max("draw").alias("last")).first()["last"]
    if last is None:
        return fit([]), labels
    sample = rows.where(F.col("draw") <= last).dropDuplicates(["draw"]).select("draw", "text")
    made = in_arrow(sample, _trained, "draw long, pattern long, at binary, value binary").collect()
    made.sort(key=lambda r: r["draw"])
    good = labels.posterior(unpacked(np.array([r["pattern"] for r in made], np.int64)))
    examples = [
        (g, np.frombuffer(r["at"], "<u2"), np.frombuffer(r["value"], "<f4"))
        for g, r in zip(good, made, strict=True)
    ]
    return fit(examples), labels


def scored(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """`doc_id, pattern, posterior, score, quality` of every row.

    `pattern` holds the votes in base three, `posterior` is what they say by themselves,
    `score` comes from the scorer, and `quality` is 1 from a score of `LEAST_SCORE` on. No labels are
    read.

    - A null text counts as empty: one labeller votes against it, the others do not vote.
    - Repeated rows give repeated rows, a null doc_id stays null, an empty table gives none.
    """
    scorer, labels = train(docs, training_rows)
    schema = "doc_id long, pattern long, posterior double, score double"
    found = in_arrow(_rows(docs).select("doc_id", "text"), _scorer(scorer, labels), schema)
    return found.withColumn("quality", (F.col("score") >= LEAST_SCORE).cast("int"))
