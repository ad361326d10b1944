"""Language ID: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow, stored
from candlewick.plans.shipping import ship_package

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
WIDTH = 16
EPOCHS = 12
RATE = 0.5
SEED = 7
# Rows the model is fitted on: so many of each language, and so many languages.
PER_LANGUAGE = 800
LANGUAGES = 256
# Every fifth of them sets temperature and threshold instead.
HELD_BACK = 5
# Accepted predictions may be wrong this often, and so many right ones may be rejected.
ERROR = 0.001
SPARED = 0.001
SHORT_OF = 0.8

_LETTER = re.compile(r"[^\W\d_]")
# Bytes of words stay; whatever else ASCII has parts them.
_WORDS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams inside words (ends marked) of a whole text, and their shares."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_WORDS) + b" ", np.uint8)
    space = data == 32
    counts = np.zeros(BUCKETS, np.int64)
    gram = data.astype(np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            gram = gram[:-1] * np.uint32(257) + data[order - 1 :]
        if len(gram) == 0:
            break
        if order == 1:
            inside = ~space
        else:
            # No space but at the ends, and not spaces alone.
            inner = np.zeros(len(gram), bool)
            for i in range(1, order - 1):
                inner |= space[i : i + len(gram)]
            inside = ~inner & ~(space[: len(gram)] & space[order - 1 :]) if order == 2 else ~inner
        hashed = (gram[inside] ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        counts += np.bincount(hashed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        made = [subwords(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("draw"),
                pa.array([m[0].astype("<u2").tobytes() for m in made], pa.binary()),
                pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
            ],
            names=["lang", "draw", "at", "share"],
        )


@dataclass(frozen=True)
class Model:
    """`table` holds each bucket's part of every language's score: embedding times softmax
    weights, so a prediction is one average."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: Usual

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its calibrated probability, and whether it is accepted; `und`, 0 and not
        without a letter. Accepted is what is sure enough among the learned languages, and
        no less like its own than texts of that language are: a text in none of them may
        well be most like one."""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, False
        at, share = subwords(text)
        scores = share @ self.table[at] + self.bias
        p = _softmax(scores / self.temperature)
        best = int(p.argmax())
        odd = self.usual.oddness(best, scores[best], share.min(initial=1.0))
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold and odd <= self.usual.most)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; `und` and 0 without a letter."""
        return self.judge(text)[:2]


@dataclass(frozen=True)
class Usual:
    """What texts of each language score for it. A score is a mean over a text's subwords, so
    it varies the more the fewer there are; `between` and `within` are the two parts of its
    variance. `most` is the oddness up to which texts are accepted."""

    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    most: float

    def oddness(self, language: int | np.ndarray, score: float | np.ndarray, rarest: float | np.ndarray):
        """How many deviations a score lies below its language's mean. The share of the rarest
        subword tells how many there are."""
        return (self.mean[language] - score) / np.sqrt(self.between[language] + self.within[language] * rarest)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Stochastic gradient descent over (language, buckets, shares), in the given order."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        none = np.zeros(0)
        return Model((), np.zeros((BUCKETS, 0)), none, 1.0, 0.0, Usual(none, none, none, 0.0))
    index = {lang: i for i, lang in enumerate(languages)}
    target = np.array([index[r[0]] for r in rows])
    draw = np.random.default_rng(SEED)
    embed = draw.normal(0, 1.0 / WIDTH, (BUCKETS, WIDTH))
    weight = np.zeros((WIDTH, len(languages)))
    bias = np.zeros(len(languages))
    train = [i for i in range(len(rows)) if i % HELD_BACK or len(rows) < HELD_BACK * len(languages)]
    # Every language weighs the same, however many of its rows there are.
    each = np.bincount(target[train], minlength=len(languages))
    balance = len(train) / (len(languages) * np.maximum(each, 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in draw.permutation(train):
            _, at, share = rows[i]
            mean = share @ embed[at]
            error = _softmax(mean @ weight + bias)
            error[target[i]] -= 1
            error *= rate * min(4.0, balance[target[i]])
            back = weight @ error
            weight -= np.outer(mean, error)
            bias -= 0.1 * error
            embed[at] -= np.outer(share, back) * 8.0
    table = embed @ weight
    back = [i for i in range(len(rows)) if i not in set(train)] or list(range(len(rows)))
    scores = np.array([rows[i][2] @ table[rows[i][1]] + bias for i in back])
    rarest = np.array([rows[i][2].min(initial=1.0) for i in back])
    temperature, threshold = _calibrated(scores, target[back])
    return Model(languages, table, bias, temperature, threshold, _usual(scores, rarest, target[back]))


def _calibrated(scores: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """The temperature of the least log loss, and the rejection threshold: the lowest
    probability from which on predictions are wrong no more often than `ERROR`, but at least
    `SHORT_OF` what all right ones but `SPARED` have. So many rows cannot show an error rarer
    than one in their number, so the loss counts each as that much wrong."""
    rows, n = np.arange(len(target)), scores.shape[1]
    choices = np.geomspace(0.01, 10, 121)
    doubt = 1 / (len(target) + 2)
    wanted = np.full(scores.shape, doubt / max(1, n - 1))
    wanted[rows, target] = 1 - doubt
    losses = [-(wanted * np.log(_softmax(scores / t) + 1e-12)).sum(axis=1).mean() for t in choices]
    temperature = float(choices[int(np.argmin(losses))])
    p = _softmax(scores / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-sure, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= ERROR)
    if len(fine) == 0:
        return temperature, 2.0  # nothing is sure enough
    lowest = 0.0 if fine[-1] == len(order) - 1 else float(sure[order[fine[-1]]])
    return temperature, max(lowest, SHORT_OF * float(np.quantile(sure[right], SPARED)))


def _usual(scores: np.ndarray, rarest: np.ndarray, target: np.ndarray) -> Usual:
    """Mean and variance of own scores from rows held back that are told right, and the
    oddness that spares all but `SPARED` of them, stretched by a quarter for rows unlike any."""
    right = scores.argmax(axis=1) == target
    scores, rarest, target = scores[right], rarest[right], target[right]
    own = scores[np.arange(len(target)), target]
    n = scores.shape[1]
    mean, between, within = np.zeros(n), np.ones(n), np.ones(n)
    for k in range(n):
        mine = target == k
        if not mine.any():
            continue
        # Long texts tell the mean best.
        weights = 1 / np.maximum(rarest[mine], 1e-6)
        mean[k] = np.average(own[mine], weights=weights)
        apart = (own[mine] - mean[k]) ** 2
        # Mean square deviation as a + b * rarest, neither below nothing.
        short = rarest[mine] > np.median(rarest[mine])
        within[k] = max(1e-9, (apart[short].mean() if short.any() else apart.mean()) / max(1e-6, rarest[mine][short].mean() if short.any() else 1.0))
        between[k] = max(1e-9, apart[~short].mean() if (~short).any() else apart.mean())
    odd = Usual(mean, between, within, 0.0).oddness(target, own, rarest)
    return Usual(mean, between, within, 1.25 * float(np.quantile(odd, 1 - SPARED)) if len(odd) else 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; so are those without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Fit on at most `PER_LANGUAGE` documents of each language, those of the lowest hash,
    each as a whole. What comes to the driver is their hashed counts: bounded in rows, and
    by `BUCKETS` in each."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.xxhash64("doc_id").alias("draw"), "doc_id", F.col("lang").cast("string"))
    by_lang = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = rows.withColumn("at", F.row_number().over(by_lang)).where(F.col("at") <= PER_LANGUAGE)
    kept = stored(chosen, "lang-sample")
    common = kept.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    kept = kept.join(F.broadcast(common), "lang", "left_semi")
    kept = kept.select("doc_id", F.col("lang").alias("_lang"), "draw").distinct()
    # The rows are bounded above, so this side is always small.
    texts = docs.where("text is not null").select(F.col("doc_id"), "lang", "text")
    sample = texts.join(F.broadcast(kept), "doc_id").where("lang = _lang")
    sample = sample.groupBy("doc_id", "lang", "draw").agg(F.min("text").alias("text"))
    found = in_arrow(
        sample.select("lang", "draw", "text"),
        _features,
        "lang string, draw long, at binary, share binary",
    ).collect()
    found.sort(key=lambda r: (r["draw"], r["lang"]))
    return fit(
        [
            (r["lang"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["share"], "<f4"))
            for r in found
            if r["at"]
        ]
    )


_RESULT = "doc_id long, lang_pred string, score double, accepted boolean"


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [model.judge(texts[i].as_py()) for i in range(len(texts))]
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            arrays = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*rest, *arrays], names=[*names, "lang_pred", "score", "accepted"]
            )

    return predict


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, accepted` of every row, from its text alone.

    - Null text, or text without a letter: `und`, score 0, not accepted.
    - Without any labelled row nothing is learned, and every row is `und`.
    - Repeated rows give repeated rows, a null doc_id stays null, an empty table none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = in_arrow(rows, _predictor(model), _RESULT)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def accepted_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is accepted, columns unchanged."""
    ship_package(docs.sparkSession)
    judge = model.judge

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        # One text at a time is a Python string.
        return pa.array([judge(texts[i].as_py())[2] for i in range(len(texts))], pa.bool_())

    return docs.where(accepted("text"))
