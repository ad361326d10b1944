"""Licence scan: notice phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

One automaton finds the words of notices in a text reduced to its words, a second one finds
identifier tags in the text as it is. What follows a tag is read as an expression of licence
names with `and`, `or`, `with` and brackets, and evaluated to what it asks of a user.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import Any, NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases of notices.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "zlib license": "zlib",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
# Tags that an expression follows; after the plain ones it must consist of known names.
TAGS = ("spdx-license-identifier", "license-expression", "license", "licence")
STRICT_TAGS = 2
# What a licence asks for, from nothing to everything; unknown names rank highest.
TERMS = ("public-domain", "permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
FAMILIES = {
    "cc0": 0, "unlicense": 0, "0bsd": 0, "public-domain": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by": 1, "python": 1, "x11": 1, "psf": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2, "eupl": 2, "ofl": 2,
    "gpl": 3, "agpl": 3, "cc-by-sa": 3, "osl": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4, "proprietary": 4,
}
# Exceptions take copyleft back to the weaker kind.
EXCEPTION = re.compile(r"exception|linking|runtime|assembly", re.ASCII)
# No licence has a longer name.
LONGEST_NAME = 64
# How sure a valid expression after a tag is, and each word of a phrase.
TAG_WEIGHT, WORD_DOUBT = 0.95, 0.5

_SIGN = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([a-z0-9][a-z0-9.+-]*|[()])")
_VERSION = re.compile(r"-(?:v?[0-9].*|clause.*|only|or-later)$")
_TABLE = bytes(
    b | 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str:
    """A licence name without its version: `gpl-2.0-or-later` and `gpl-3.0+` are `gpl`."""
    name = name.lower().rstrip("+")
    if len(name) > LONGEST_NAME:
        return name
    while name not in FAMILIES and (cut := _VERSION.sub("", name)) != name:
        name = cut
    return name


class Expression(NamedTuple):
    """An expression: names in order, and the index in `TERMS` of what it asks for; null if
    operators and names do not fit together."""

    names: tuple[str, ...]
    terms: int | None


def evaluate(tokens: list[str]) -> Expression:
    """Shunting-yard over names, `and`, `or`, `with` and brackets.

    Operators wait on a stack until one that binds less comes; values are evaluated as
    operators leave it, so there is no tree. `and` asks for the most of both sides, `or`
    for the least, `with` weakens copyleft if its right side is an exception.
    """
    names: list[str] = []
    values: list[int] = []
    waiting: list[str] = []

    def apply(operator: str) -> bool:
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        if operator == "with":
            values.append(2 if right < 0 and left == 3 else left)
        else:
            # An exception stands nowhere but behind `with`.
            if left < 0 or right < 0:
                return False
            values.append(max(left, right) if operator == "and" else min(left, right))
        return True

    operand = True  # whether a name or an opening bracket has to come
    for token in tokens:
        if token == "(" or token not in _BINDS and token != ")":
            if not operand:
                return Expression(tuple(names), None)
            if token == "(":
                waiting.append(token)
                continue
            if waiting and waiting[-1] == "with":
                values.append(-1 if EXCEPTION.search(token) else len(TERMS))
            else:
                names.append(token)
                values.append(FAMILIES.get(family(token), len(TERMS) - 1))
            operand = False
            continue
        if operand:
            return Expression(tuple(names), None)
        if token == ")":
            while waiting and waiting[-1] != "(":
                if not apply(waiting.pop()):
                    return Expression(tuple(names), None)
            if not waiting:
                return Expression(tuple(names), None)
            waiting.pop()
            continue
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
            if not apply(waiting.pop()):
                return Expression(tuple(names), None)
        waiting.append(token)
        operand = True
    while waiting:
        if (operator := waiting.pop()) == "(" or not apply(operator):
            return Expression(tuple(names), None)
    valid = not operand and len(values) == 1 and 0 <= values[0] < len(TERMS)
    return Expression(tuple(names), values[0] if valid else None)


def read_expression(text: bytes, at: int) -> tuple[list[str], int]:
    """Tokens from `at` on to the end of the line or of what can be an expression, and the
    place behind the last one kept. Two names in a row end it before the second, and so does
    a closing bracket that none opened."""
    tokens: list[str] = []
    end, depth = at, 0
    while (found := _TOKEN.match(text, end)) is not None:
        token = found[1].decode("ascii")
        named = bool(tokens) and tokens[-1] not in _BINDS and tokens[-1] != "("
        if (named and token not in _BINDS and token != ")") or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        tokens.append(token)
        end = found.end()
    # In prose a name may be followed by an operator that joins something else.
    while tokens and tokens[-1] in _BINDS:
        tokens.pop()
    return [t.rstrip(".") or t for t in tokens], end


@cache
def _phrases() -> Any:
    """Automaton over words between single blanks, one latin-1 letter a byte."""
    found = ahocorasick.Automaton()
    for phrase, label in {**PHRASES, **BASE}.items():
        found.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, len(phrase) + 2, phrase in BASE))
    found.make_automaton()
    return found


@cache
def _tags() -> Any:
    found = ahocorasick.Automaton()
    for rank, tag in enumerate(TAGS):
        found.add_word(tag, (rank, len(tag)))
    found.make_automaton()
    return found


def places(text: bytes) -> tuple[int, list[tuple[str, int, int, bool]]]:
    """Number of words, and (label, first word, words, base) of each phrase in the text."""
    words = text.translate(_TABLE).split()
    if not words:
        return 0, []
    joined = b" " + b" ".join(words) + b" "
    found = []
    at, before = 0, -1
    hits = ((end + 1 - size, label, n, base) for end, (label, n, size, base) in _phrases().iter(joined.decode("latin-1")))
    for start, label, n, base in sorted(hits):
        before += joined.count(b" ", at, start + 1)
        at = start + 1
        found.append((label, before, n, base))
    return len(words), found


def tagged(text: bytes) -> list[tuple[int, int, Expression]]:
    """(start, end, expression) of each identifier tag and what follows it, in bytes."""
    lowered = text.translate(_LOWER)
    if b"licen" not in lowered:
        return []
    found = []
    past = 0
    for last, (rank, size) in _tags().iter(lowered.decode("latin-1")):
        start = last + 1 - size
        if start < past or start and lowered[start - 1 : start].isalnum():
            continue
        sign = _SIGN.match(lowered, last + 1)
        if sign is None:
            continue
        tokens, end = read_expression(lowered, sign.end())
        expression = evaluate(tokens)
        known = expression.terms is not None and all(family(n) in FAMILIES for n in expression.names)
        if tokens and (rank < STRICT_TAGS or known):
            found.append((start, end, expression))
            past = end
    return found


def scan(text: bytes) -> tuple[int, list[dict], list[dict], float]:
    """Words, phrases, expressions and score of a UTF-8 text. The score is the chance that
    not all of its evidence, taken once for each label, is by accident."""
    n_words, phrases = places(text)
    expressions = []
    sure: dict[str, float] = {}
    for label, _, n, _ in phrases:
        sure[label] = max(sure.get(label, 0.0), 1 - WORD_DOUBT**n)
    before, chars = 0, 0
    for start, end, (names, terms) in tagged(text):
        labels = sorted({f for f in map(family, names) if f in FAMILIES})
        for label in labels:
            sure[label] = max(sure.get(label, 0.0), TAG_WEIGHT if terms is not None else 1 - WORD_DOUBT)
        # Places are told in code points.
        chars += len(text[before:start].decode("utf-8", "replace"))
        first = chars
        chars += len(text[start:end].decode("utf-8", "replace"))
        before = end
        expressions.append(
            {
                "start": first,
                "end": chars,
                "names": list(names),
                "labels": labels,
                "terms": "invalid" if terms is None else TERMS[terms],
            }
        )
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1 - sure[label]
    fields = ("label", "word", "n_words", "base")
    return n_words, [dict(zip(fields, p, strict=True)) for p in phrases], expressions, round(1 - doubt, 6)


_PHRASE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_())])
_EXPRESSION = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("names", pa.list_(pa.string())),
     ("labels", pa.list_(pa.string())), ("terms", pa.string())]
)
SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<label:string,word:long,n_words:long,base:boolean>>, "
    "expressions array<struct<start:long,end:long,names:array<string>,labels:array<string>,terms:string>>, score double"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.list_(_PHRASE), pa.list_(_EXPRESSION), pa.float64())
    names = ["doc_id", "n_words", "phrases", "expressions", "score"]
    for batch in batches:
        texts = batch.column("text")
        found = [scan(texts[i].as_buffer().to_pybytes()) for i in range(len(texts))]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def license_notices(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, phrases, expressions, score` of every row of `docs`.

    `phrases` holds label, place (in words from 0) and length of each notice phrase, the
    base ones marked; `expressions` what follows identifier tags: place in code points,
    licence names, labels and terms (`invalid` if it cannot be parsed).

    - A null text counts as empty: no words, no phrases, score 0. A null doc_id stays null.
    - Repeated rows give repeated rows; an empty table gives none.
    - Phrases that overlap are all reported. Other columns of `docs` are not read.

    No row needs another, so nothing is shuffled.
    """
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), _scanned, SCHEMA)


def digested(notices: DataFrame) -> DataFrame:
    """One row of plain columns per text: the base phrases counted and placed, the labels."""
    base = F.filter("phrases", lambda p: p["base"])
    found = F.concat(F.col("phrases.label"), F.flatten(F.col("expressions.labels")))

    def listed(labels: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return notices.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        listed(base["label"]).alias("base_labels"),
        listed(found).alias("labels"),
        "score",
        F.array_join(F.col("expressions.terms"), ",").alias("terms"),
    )
