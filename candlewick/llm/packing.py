"""Packing along a Hilbert curve: documents with like vectors share sequences."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm.shared import in_arrow, in_order, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
LENGTH = 2048
# Hashed document vectors, their projection, and the grid of the curve.
BUCKETS, DIMENSIONS, GRID_BITS = 256, 3, 10
SEED = 20240917
# Chunks of text and words whose ids a worker remembers: so many new ones, and as many of before.
REMEMBERED = 400_000

# Texts of these letters only are split by white space without changing any id: they are
# their own composed form, lower-case one letter at a time, and hold no odd spaces.
_PLAIN = re.compile(r"[^\t\n\r -~¡-įĲ-ňŊ-ɏ‐-‧]")


# Byte-level vocabularies write the bytes that have no visible letter as letters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


# This split takes runs of letters and of marks whole, so most chunks need no search.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = ".,;:!?|"


class Ids:
    """Token ids of whole texts as `tokenizers` gives them, with remembered chunks."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        split = _split_pattern(spec)
        self.split = split and regex.compile(split)
        self.runs = split == _RUNS

    def _encoded(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _kept(self, chunk: str, ids: bytes) -> bytes:
        # What is met again moves on from the chunks of before; the rest goes with them.
        if len(self.known) >= REMEMBERED:
            self.before = dict(self.known)
            self.known.clear()
        self.known[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one split word: only the vocabulary model is left to apply."""
        # A word that may be split as a chunk is kept beside the chunk.
        key = word if self.runs else " " + word
        ids = self.known.get(key)
        if ids is None:
            ids = self.before.get(key)
            if ids is None:
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()
            self._kept(key, ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """A chunk is split as the tokenizer does, and its words are remembered as well."""
        if self.runs and chunk.isalpha():
            return self._word(chunk)
        ids = self.before.get(chunk)
        if ids is None:
            letters = chunk.rstrip(_MARKS) if self.runs else ""
            if letters.isalpha():
                words = [letters, chunk[len(letters) :]]
            else:
                words = self.split.findall(chunk)
            ids = b"".join(map(self._word, words))
        return self._kept(chunk, ids)

    def of(self, text: str) -> np.ndarray:
        if (
            self.split is None
            or any(t in text for t in self.special)
            or (not text.isascii() and _PLAIN.search(text))
            or (text.isascii() and not text.isprintable() and _PLAIN.search(text))
        ):
            return np.frombuffer(self._encoded(text), self.kind)
        known, chunk = self.known.get, self._chunk  # no chunk is without ids
        return np.frombuffer(b"".join([known(c) or chunk(c) for c in text.lower().split()]), self.kind)


def _split_pattern(spec: dict) -> str | None:
    """The pattern that splits words, where this tokenizer drops all white space: only then
    do the ids of a text follow from those of its chunks."""
    try:
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        fits = normal == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed"
        fits = fits and split["invert"] and level["type"] == "ByteLevel"
        fits = fits and not level["add_prefix_space"] and not level["use_regex"]
        return split["pattern"]["Regex"] if fits else None
    except (KeyError, TypeError, ValueError):
        return None


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


@lru_cache(maxsize=2)
def _hashing(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of every token id, and the projection of the buckets."""
    draw = np.random.default_rng(SEED)
    bucket = draw.integers(0, BUCKETS, vocabulary)
    sign = draw.choice([-1.0, 1.0], vocabulary)
    return bucket, sign, draw.standard_normal((BUCKETS, DIMENSIONS))


def document_vector(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Hashed counts of length 1, projected to a few dimensions; zero without tokens."""
    bucket, sign, projection = _hashing(vocabulary)
    vector = np.bincount(bucket[ids], weights=sign[ids], minlength=BUCKETS)
    norm = np.sqrt(vector @ vector)
    return (vector / norm if norm else vector) @ projection


_AXES = [f"v{i}" for i in range(DIMENSIONS)]
_TOKENS = "doc_id long, row long, n long, " + "".join(f"{a} double, " for a in _AXES) + "ids binary"


def _tokenizer(path: str, end: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(path)
        vocabulary = ids_of.whole.get_vocab_size()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, out, vectors, sizes = batch.column("text"), [], [], []
            for i in range(len(texts)):
                ids = ids_of.of(texts[i].as_py())
                vectors.append(document_vector(ids, vocabulary))
                ids = np.append(ids, ids_of.kind(end))
                sizes.append(len(ids))
                out.append(squeeze(ids.tobytes()))
            arrays = [batch.column("doc_id"), pa.array(np.arange(row, row + len(out)))]
            arrays.append(pa.array(sizes, pa.int64()))
            arrays += [pa.array([v[a] for v in vectors], pa.float64()) for a in range(DIMENSIONS)]
            row += len(out)
            names = [field.split()[0] for field in _TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.binary())], names=names)

    return tokens


def hilbert_key(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Place on the Hilbert curve of grid points (n, dimensions), all at once.

    After Skilling's transposed form: turn and mirror the axes from the highest bit down,
    take the Gray code over the axes, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            on = x[i] & high != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << bit) != 0, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> bit & 1
    return key


def _pieces(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        schema = pa.schema(
            [("doc_id", pa.int64()), *((c, pa.int64()) for c in _PIECE_COUNTS), ("ids", pa.binary())]
        )
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "before", "n"))
            for i, (doc, before, n) in enumerate(zip(*columns, strict=True)):
                data = expand(batch.column("ids")[i].as_py())
                ids = np.frombuffer(data, f"u{len(data) // n}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(before + start, length)
                    stop = min(n, start + length - offset)
                    data = ids[start:stop].tobytes()
                    rows.append((doc, start, stop - start, zlib.crc32(data), n, sequence, offset, data))
                    start = stop
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return cut


_PIECE_COUNTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, path: str = TOKENIZER, end: int = END, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids` (little-endian unsigned 32-bit ids).

    Documents follow each other along the curve and are cut wherever a sequence is full, so
    only the last sequence has room left. Only numbers are sorted; the ids are moved once.

    - A null text counts as empty and is its end id alone.
    - Repeated rows are packed each by itself; a null doc_id stays null. Ties on the curve
      are broken by doc_id, then by the row's place in the input.
    - An empty table gives no pieces. Other columns of `docs` are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    tokens = stored(in_arrow(rows, _tokenizer(path, end), _TOKENS), "tokens")
    moments = [f(a).alias(f"{a}_{n}") for a in _AXES for n, f in (("mean", F.mean), ("std", F.stddev_pop))]
    stats = tokens.agg(*moments).first()  # six numbers
    means = np.array([stats[f"{a}_mean"] or 0.0 for a in _AXES])
    spreads = np.array([stats[f"{a}_std"] or 1.0 for a in _AXES])
    grid = (1 << GRID_BITS) - 1

    @F.pandas_udf("long")
    def place(v0: pd.Series, v1: pd.Series, v2: pd.Series) -> pd.Series:
        scaled = (np.stack([v0, v1, v2], axis=1) - means) / spreads
        # Close to equal shares of the documents on every line of the grid.
        even = 1.0 / (1.0 + np.exp(-1.702 * scaled))
        return pd.Series(hilbert_key(np.rint(even * grid)))

    narrow = tokens.select(place(*_AXES).alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("_id"), "row", "n")
    order = in_order(narrow, ["key", "_id", "row"], F.col("n"), "curve").select("row", "before")
    # The side with two numbers per document is the one held in memory.
    placed = tokens.select("row", "doc_id", "n", "ids").join(order.hint("shuffle_hash"), "row")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _PIECE_COUNTS) + ", ids binary"
    return in_arrow(placed.select("doc_id", "before", "n", "ids"), _pieces(length), schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """`sequence_id, ids, tokens`: whole sequences, the last padded with `pad`."""
    part = F.struct("offset", "ids")
    padding = int(pad).to_bytes(4, "little")
    joined = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.sum("length").alias("tokens")
    )
    data = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", F.rpad(data, 4 * length, F.lit(padding)).alias("ids"), "tokens")
