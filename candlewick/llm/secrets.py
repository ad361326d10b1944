"""Secret scan by assignment-aware lexing.

Three base patterns find secrets by their look. The lexer reads assignments of source
and configuration files, follows constants through names and concatenations, and adds
the literals that reach a name that sounds secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import in_arrow

# The base patterns.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

# How much a word of a name speaks for a secret, or against one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9,
    "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6,
    "bearer": 0.7, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4,
}
PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("client", "key"): 0.6,
         ("signing", "key"): 0.8, ("encryption", "key"): 0.8, ("connection", "string"): 0.6}
HARMLESS = {"public", "example", "sample", "dummy", "test", "count", "length", "max", "min", "limit",
            "type", "name", "url", "path", "file", "field", "label", "hint", "policy", "id"}
PLACEHOLDER = re.compile(r"change_?me|your[_-]|example|placeholder|xxxx|\*{3}|<[^>]*>|none|null|true|false", re.I)
LEAST_LETTERS = 8
LEAST_SCORE = 0.5

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z0-9_$]+)*"
_SIGN = re.compile(r"(:=|=>|\+=|=(?![=~>])|:(?![:/]))[ \t]*")
_NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_TERM = re.compile(
    rf"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|\$\{{({_NAME})\}}|({_NAME})|([A-Za-z0-9+/_=][A-Za-z0-9+/_.=-]*)",
    re.ASCII,
)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\||&)[ \t]*|[ \t]+(?=[\"'`])")
_INSERT = re.compile(rf"\$?\{{({_NAME})\}}", re.ASCII)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int]


def name_score(name: str) -> float:
    """How secret the last part of a name sounds, 0 to 1."""
    words = [w.lower() for w in _WORD.findall(name.rpartition(".")[2])]
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    score = max([score, *(PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])
    return score * (0.4 if any(w in HARMLESS for w in words) else 1.0)


class Value:
    """What a name was given: the literals that went into it, and how they look together.

    Holds its parts instead of their text, and letter counts instead of letters, so that a
    value made of others costs no more than a literal, however often it is put together.
    """

    __slots__ = ("span", "parts", "length", "letters", "harmless", "told")

    def __init__(self, span: Span | None = None, text: str = "") -> None:
        self.span = span
        self.parts: list[Value] = []
        self.length = float(len(text))
        self.letters: dict[str, float] = dict(Counter(text))
        self.harmless = bool(PLACEHOLDER.search(text)) or any(c.isspace() for c in text)
        self.told = False

    def put(self, other: Value, span_only: bool = False) -> None:
        """Put another value behind; `span_only` if its text is in this one's already."""
        self.parts.append(other)
        if span_only:
            return
        self.length += other.length
        self.harmless |= other.harmless
        for letter, n in other.letters.items():
            self.letters[letter] = self.letters.get(letter, 0.0) + n
        if self.length > _LONG:
            # Shares are what counts from here on.
            self.letters = {c: n / 2 for c, n in self.letters.items()}
            self.length /= 2

    def spans(self) -> Iterator[Span]:
        """Spans of all literals in it that have not been told before."""
        left = [self]
        while left:
            one = left.pop()
            if not one.told:
                one.told = True
                if one.span is not None:
                    yield one.span
                left += one.parts


_LONG = 1e9


def literal_score(value: Value | str) -> float:
    """How random a literal looks, 0 to 1: entropy per letter, and kinds of letters."""
    if isinstance(value, str):
        value = Value(None, value)
    if value.length < LEAST_LETTERS or value.harmless:
        return 0.0
    shares = [n / value.length for n in value.letters.values()]
    entropy = -sum(p * math.log2(p) for p in shares if p > 0)
    kinds = sum(any(f(c) for c in value.letters) for f in (str.islower, str.isupper, str.isdigit))
    kinds += any(not c.isalnum() for c in value.letters)
    return min(1.0, entropy / 3.5) * (1.0 if kinds > 1 else 0.5)


def _name_before(text: str, low: int, end: int) -> str | None:
    """The name that ends right before `end`, after blanks, a bracket and a quote; not before `low`."""
    while end > low and text[end - 1] in " \t":
        end -= 1
    if end > low and text[end - 1] == "]":
        end -= 1
    if end > low and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start > low and text[start - 1] in _NAME_LETTERS:
        start -= 1
    # Parts between dots or dashes: all of them up to an empty one, from the first that
    # begins like a name.
    parts: list[str] = []
    for part in reversed(re.split(r"[.\-]", text[start:end])):
        if not part:
            break
        parts.append(part)
    while parts:
        first = parts[-1].lstrip("0123456789")
        if first:
            at = sum(map(len, parts)) + len(parts) - 1 - (len(parts[-1]) - len(first))
            return text[end - at : end]
        parts.pop()
    return None


def _target(text: str, at: int) -> tuple[str, str, int] | None:
    """The next name that is given something: name, sign, and where the value begins. Looks
    for signs and then backwards, so that a long run of letters is read once."""
    low = at
    while (sign := _SIGN.search(text, at)) is not None:
        name = _name_before(text, low, sign.start())
        if name is not None:
            return name, sign[1], sign.end()
        at = sign.start() + 1
        low = max(low, sign.start())
    return None


def named_literals(text: str) -> set[Span]:
    """Spans of literals that reach a sensitive name, directly or through constants.

    Statements are read in order; `constants` holds for each name the value it was last
    given.
    """
    constants: dict[str, Value] = {}
    found: set[Span] = set()
    at = 0
    while (target := _target(text, at)) is not None:
        name, sign, begins = target
        end, value, terms = begins, Value(), 0
        while (term := _TERM.match(text, end)) is not None:
            which = term.lastindex
            if which is None:
                break
            if which <= 3:
                if term[which]:
                    value.put(Value(term.span(which), term[which]))
                for inner in _INSERT.findall(term[which]):
                    if inner in constants:
                        value.put(constants[inner], span_only=True)
            elif term[which] in constants:
                value.put(constants[term[which]])
            elif which != 4 and not terms:
                # A bare value, as in configuration files.
                value = Value(term.span(which), term[which])
            end, terms = term.end(), terms + 1
            joined = _JOIN.match(text, end)
            if joined is None:
                break
            end = joined.end()
        if not terms:
            at = begins
            continue
        if sign == "+=" and name in constants:
            both = Value()
            both.put(constants[name])
            both.put(value)
            value = both
        constants[name] = value
        if (value.parts or value.span) and name_score(name) * literal_score(value) >= LEAST_SCORE:
            found.update(value.spans())
        # The value may itself be a target, as in `a = b = "..."`.
        following = _SIGN.search(text, begins, min(len(text), end + 3)) if terms == 1 else None
        chained = following is not None and _name_before(text, begins, following.start()) is not None and following.start() >= end - 1
        at = begins if chained else max(end, begins)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; a match that is too short is dropped whole."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str) -> tuple[int, int, int, int, str, str]:
    base = base_spans(text)
    added = []
    if ":" in text or "=" in text:
        starts = [s for s, _, _ in base]
        reach = list(accumulate((e for _, _, e in base), max))
        for start, end in named_literals(text):
            before = bisect_right(starts, start)
            if not before or reach[before - 1] < end:
                added.append((start, 3, end))
    counts = Counter(kind for _, kind, _ in base)
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return counts[0], counts[1], counts[2], len(added), digest, _joined(sorted(base + added))


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, "
    "base_sha256 string, spans string"
)
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    for batch in batches:
        texts = batch.column("text")
        found = [scan(texts[i].as_py()) for i in range(len(texts))]
        columns = list(zip(*found, strict=True)) or [[] for _ in names[1:]]
        arrays = [batch.column("doc_id")]
        arrays += [pa.array(c, t) for c, t in zip(columns, _TYPES[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every text, in code points, end exclusive.

    - A null text counts as empty and has no spans. A null doc_id stays null.
    - Repeated rows give repeated rows; an empty table gives none.
    - An added literal that lies inside a base span is not reported again.
    - Other columns of `docs` are not read.

    No row needs another, so nothing is shuffled.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return in_arrow(rows, _scanned, SCHEMA)
