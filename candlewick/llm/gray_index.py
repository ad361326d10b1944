"""SimHash near-duplicates found through a Gray-order hierarchical index.

Fingerprints that differ in at most `bits` of 64 agree wholly on one of `bits + 1` masks, so
the top nodes of the index are the masked patterns: every fingerprint hangs below one node
per mask, and the nodes are dealt over the tasks. Below a node the fingerprints are sorted
by Gray rank, and every eight neighbours get an upper node with the bits they share. A
search goes down with the differences to shared bits added up, and leaves a whole group as
soon as there are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import groups_of, in_arrow, stored
from candlewick.llm.sketch import may_contain

SHINGLE = 3
BITS = 2
SEED = 42
FAN_OUT = 8
# Rows below one top node that one task takes; a larger node is factored by further masks.
NODE_ROWS = 50_000
# Searches that go down the index together.
BLOCK = 1 << 15
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and exactly the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1))
        hashes = [
            digest(joined[a:b], seed)
            for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    n = len(hashes)
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    counts = np.bincount((octets + _OCTET).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


_OCTET = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = [simhash(texts[i].as_buffer().to_pybytes()) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id, fp` of every whole text; a null text counts as empty."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return in_arrow(rows, _fingerprinted, "doc_id long, fp long")


def masks(n: int, within: int = (1 << 64) - 1) -> list[int]:
    """Cut the bits of a mask into n parts of like size."""
    bits = [i for i in range(64) if within >> i & 1]
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected binary code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def linked(prints: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints sorted by (node, Gray rank): (i, root), so that i and root are of
    one group under links of at most `bits` bits within a node."""
    n = len(prints)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    segment = np.cumsum(np.r_[False, node[1:] != node[:-1]])
    # Levels from the leaves up: shared bits (`mask`) and their pattern, within segments.
    levels = [(prints, np.full(n, ~np.uint64(0)), None)]
    bounds, seg = starts, segment
    while len(levels[-1][0]) > len(starts):
        pattern, mask, _ = levels[-1]
        place = np.arange(len(seg)) - bounds[seg]
        firsts = np.flatnonzero(place % FAN_OUT == 0)
        ands = np.bitwise_and.reduceat(pattern & mask, firsts)
        ors = np.bitwise_or.reduceat(pattern & mask, firsts)
        kept = np.bitwise_and.reduceat(mask, firsts) & ~(ands ^ ors)
        levels.append((ands & kept, kept, np.r_[firsts, len(seg)]))
        seg = seg[firsts]
        bounds = np.searchsorted(seg, np.arange(len(starts)))
    for low in range(0, n, BLOCK):
        query = np.arange(low, min(low + BLOCK, n))
        at = segment[query]
        pattern, mask, _ = levels[-1]
        apart = _count((prints[query] ^ pattern[at]) & mask[at])
        for level in range(len(levels) - 1, 0, -1):
            near = apart <= bits
            query, at, apart = query[near], at[near], apart[near]
            upper, bounds = levels[level][1], levels[level][2]
            first, many = bounds[at], bounds[at + 1] - bounds[at]
            above = np.repeat(np.arange(len(at)), many)
            at_child = np.arange(len(above)) - np.repeat(np.cumsum(many) - many, many) + first[above]
            query, apart, parent = query[above], apart[above], at[above]
            pattern, mask, _ = levels[level - 1]
            # Only the bits that the child shares beyond its parent are counted anew.
            fresh = mask[at_child] & ~upper[parent]
            apart = apart + _count((prints[query] ^ pattern[at_child]) & fresh)
            at = at_child
        hit = (apart <= bits) & (at < query)
        _unite(root, query[hit], at[hit])
    return np.arange(n), _roots(root)


def _roots(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root[:] = up


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of all pairs at once, the smaller root winning."""
    while len(a):
        _roots(root)
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _searcher(bits: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("node").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not parts:
            return
        node, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
        prints = prints.view(np.uint64)
        order = np.lexsort((gray_rank(prints), node))
        node, prints = node[order], prints[order]
        # A fingerprint alone below its node has nothing to be compared with.
        same = node[1:] == node[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        node, prints = node[shared], prints[shared]
        if not len(node):
            return
        item, root = linked(prints, node, bits)
        joined = item != root
        signed = prints.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed[item[joined]]), pa.array(signed[root[joined]])], names=["a", "b"]
        )

    return search


def _hung(rows: DataFrame, within: list[int], bits: int) -> DataFrame:
    """Rows under a node for each mask: `fp, mask, node`. Equal patterns, equal nodes."""

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    under = F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in within])).alias("mask")
    hung = rows.select("fp", under)
    return hung.withColumn("node", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def links(prints: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """`a, b`: fingerprints joined into groups below each top node, no pair twice.

    `prints` holds different `fp`. A node with more than `node_rows` rows is factored again:
    its rows agree on the node's mask, so they agree on one of `bits + 1` parts of the rest.
    Only such rows are hung again, and after three rounds any node is small, or its rows
    differ in a few bits only, of which there are not many values.
    """
    tree = [(1 << 64) - 1]
    whole, found = prints, []
    for depth in range(3):
        parts = [m for t in tree for m in masks(bits + 1, t)] if depth else masks(bits + 1)
        if depth == 0:
            hung = _hung(whole, parts, bits)
        else:
            # Next mask under a node: its own, and a part of the rest.
            pairs = F.create_map(
                *[
                    x
                    for own in tree
                    for x in (
                        F.lit(own - (1 << 64) if own >> 63 else own).cast("long"),
                        F.array(
                            *[
                                F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
                                for rest in masks(bits + 1, ~own & ((1 << 64) - 1))
                                for m in [own | rest]
                            ]
                        ),
                    )
                ]
            )
            hung = whole.select("fp", F.explode(pairs[F.col("mask")]).alias("mask"))
            hung = hung.withColumn("node", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
            parts = [own | rest for own in tree for rest in masks(bits + 1, ~own & ((1 << 64) - 1))]
        if depth == 2:
            found.append(hung)
            break
        large = hung.groupBy("node").count().where(F.col("count") > node_rows).select("node")
        large = stored(large, "large-nodes")
        if large.isEmpty():
            found.append(hung)
            break
        found.append(hung.join(large, "node", "left_anti").select(hung.columns))
        whole = stored(hung.join(large, "node", "left_semi").select("fp", "mask"), "large-rows")
        tree = parts
    edges = None
    for hung in found:
        dealt = hung.select("node", "fp").repartition("node")
        some = in_arrow(dealt, _searcher(bits), "a long, b long")
        edges = some if edges is None else edges.unionByName(some)
    return edges


def near_groups(docs: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """`doc_id, fp, component_id`, one row per row of `docs`.

    `component_id` is the smallest doc_id that can be reached over fingerprints at most
    `bits` bits apart; equal fingerprints are one point of the search, however many
    documents have them.

    - A null or wordless text has fingerprint 0 and is linked like any other.
    - A null doc_id counts only where a group has no other: then component_id is null.
    - Repeated rows give repeated rows; an empty table gives none.
    """
    rows = stored(fingerprints(docs), "simhash")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    named = _components(points.select("fp"), bits, node_rows)
    named = stored(named.join(points, "fp"), "gray-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(named.join(least, "root").select("fp", "component_id"), "gray-components")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def _components(points: DataFrame, bits: int, node_rows: int) -> DataFrame:
    """`fp, root` for different fingerprints."""
    groups = stored(groups_of(links(points, bits, node_rows), "gray"), "gray-groups")
    joined = points.join(groups, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row of the smallest
    doc_id (null last), then of the smallest hash of doc_id and text; columns as they are.

    Rows are told apart by doc_id and text together: unrelated texts all stay, whatever
    their ids. Rows equal in both are one group, of which the smallest, column by column,
    stays. A null text counts as empty; an empty table gives no rows.

    The search moves numbers only. Rows that surely stay are not shuffled; those that go, and
    the few that a bitmap cannot tell from them, are.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    dk = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("dk")
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    prints = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), dk, text), _printed, "doc_id long, dk long, fp long")
    rows = stored(prints, "gray-rows")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "dk")
    points = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "gray-points")
    named = stored(_components(points.select("fp"), bits, node_rows).join(points, "fp"), "gray-named")
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    stay = stored(named.join(least, "root").select("fp", F.col("first.dk").alias("stays")), "gray-stay")
    by_dk = rows.join(stay, "fp").groupBy("dk").agg(F.count("*").alias("n"), F.bool_or(F.col("dk") != F.col("stays")).alias("goes"))
    some = stored(by_dk.where("goes or n > 1").select("dk", "goes"), "gray-some")
    keyed = docs.select(dk, F.struct(*columns).alias("row")).withColumn("some", may_contain(some.select("dk"), F.col("dk")))
    surely = keyed.where("not some").select("row.*")
    left = keyed.where("some").join(some.where("goes").select("dk"), "dk", "left_anti")
    return surely.unionByName(left.groupBy("dk").agg(F.min("row").alias("row")).select("row.*"))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = [simhash(texts[i].as_buffer().to_pybytes()) for i in range(len(texts))]
        columns = [batch.column("doc_id"), batch.column("dk"), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "dk", "fp"])
