"""Licence scan, spelling variants and resampling against plain forms of their contracts."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import licenses, queries, resampling, spelling

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import assert_same, duck  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
SCHEMA = "doc_id long, text string, n long, word string, key string, row int, weight int, rank string"
TEXTS = [
    "Licensed under the Apache License, Version 2.0. apache-license APACHE  LICENSE",
    "gnu general public license gnu general public license. CC BY, cc by-nc 4.0",
    None,
    "",
    " \n\t--",
    "mit licensee, the mit licence; MIT\x00License",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0",
    "ünï license: MPL-2.0\nlicense: whatever follows here\n\"license\": \"BSD-3-Clause\"",
    "colour colours color colour colour colours colors ÉTÉS étés étés",
    "hello helo hello helo helo hello hello helloo helloo helloo " * 3,
    ("x" * 300 + " " + "x" * 299 + "y ") * 3 + ("x" * 301 + " ") * 3,
    "hello world " * 20_000,
]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "a", "b", 2, 3, "c") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[9], (None, TEXTS[9], 1, "a", "b", 2, 3, "c"), (None, None, 1, "a", "b", 2, 3, "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(*frames):
    return [(r.doc_id, r.text) for r in frames[0].select("doc_id", "text").collect()]


# -- licences ------------------------------------------------------------------------


def test_base_phrases_by_brute_force(docs, real, empty):
    phrases = {tuple(p.split()): label for p, label in licenses.BASE.items()}
    for frame in (docs, real):
        got = licenses.digested(licenses.license_notices(frame)).collect()
        want = []
        for doc_id, text in table(frame):
            words = WORD.findall(lowered(text))
            hits = [
                (i, label)
                for i in range(len(words))
                for p, label in phrases.items()
                if tuple(words[i : i + len(p)]) == p
            ]
            at = [i for i, _ in hits]
            labels = ",".join(sorted({label for _, label in hits}))
            want.append((doc_id, len(words), len(hits), min(at, default=None), max(at, default=None), labels))
        fields = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[f] for f in fields)) for r in got)
        for r in got:
            labels = r.labels.split(",") if r.labels else []
            assert labels == sorted(set(labels)) and set(r.base_labels.split(",")) - {""} <= set(labels)
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert licenses.digested(licenses.license_notices(empty)).count() == 0


def test_all_phrases_by_brute_force():
    random.seed(3)
    phrases = {**licenses.PHRASES, **licenses.BASE}
    pool = sorted({w for p in phrases for w in p.split()})
    for _ in range(200):
        words = random.choices(pool, k=60) + random.choice(sorted(phrases)).split()
        text = "".join(w.title() + random.choice([" ", ", ", "\n", "-"]) for w in words)
        n, found = licenses.places(text.encode())
        want = sorted(
            (label, i, p.count(" ") + 1, p in licenses.BASE)
            for p, label in phrases.items()
            for i in range(len(words))
            if words[i : i + p.count(" ") + 1] == p.split()
        )
        assert n == len(words) and sorted(found) == want


def climb(tokens: list[str]):
    """The grammar by recursive descent: None if the tokens do not fit it."""

    def level(at: int, binds: int):
        if binds > 3:
            if at < len(tokens) and tokens[at] == "(":
                inner = level(at + 1, 1)
                return (inner[0], inner[1] + 1) if inner and tokens[inner[1] : inner[1] + 1] == [")"] else None
            if at < len(tokens) and tokens[at] not in ("and", "or", "with", "(", ")"):
                return licenses.FAMILIES.get(licenses.family(tokens[at]), 5), at + 1
            return None
        left = level(at, binds + 1)
        word = {1: "or", 2: "and", 3: "with"}[binds]
        while left and left[1] < len(tokens) and tokens[left[1]] == word:
            value, at = left[0], left[1] + 1
            if word == "with":
                if at >= len(tokens) or tokens[at] in ("and", "or", "with", "(", ")"):
                    return None
                weak = value == 3 and licenses.EXCEPTION.search(tokens[at])
                left = 2 if weak else value, at + 1
            else:
                right = level(at, binds + 1)
                left = right and ((max if word == "and" else min)(value, right[0]), right[1])
        return left

    found = level(0, 1)
    return found[0] if found and found[1] == len(tokens) else None


def test_expressions_by_recursive_descent():
    random.seed(5)
    pool = ["mit", "gpl-3.0", "cc0-1.0", "lgpl-2.1+", "odd", "and", "or", "with", "classpath-exception-2.0", "(", ")"]
    short = [list(t) for n in range(5) for t in product(["mit", "gpl-2.0", "and", "or", "(", ")"], repeat=n)]
    long = [random.choices(pool, k=random.randint(1, 9)) for _ in range(4000)]
    fitting = 0
    for tokens in short + long:
        # Brackets behind `with` belong to no expression.
        if any(a == "with" and b == "(" for a, b in zip(tokens, tokens[1:], strict=False)):
            continue
        want = climb(tokens)
        assert licenses.evaluate(tokens).terms == want, tokens
        fitting += want is not None
    assert fitting > 100


def test_tags_and_terms():
    def terms(text):
        return [(e["terms"], e["names"]) for e in licenses.scan(text.encode())[2]]

    assert terms(TEXTS[6]) == [("weak-copyleft", ["mit", "apache-2.0", "gpl-2.0-only"])]
    assert terms(TEXTS[7]) == [("weak-copyleft", ["mpl-2.0"]), ("permissive", ["bsd-3-clause"])]
    assert terms("SPDX-License-Identifier: (MIT OR") == [("invalid", ["mit"])]
    assert terms("my license is old") == [] and terms("license: the best thing") == []
    found = licenses.scan(TEXTS[7].encode())[2]
    assert [TEXTS[7][e["start"] : e["end"]] for e in found] == ["license: MPL-2.0", 'license": "BSD-3-Clause']
    for text in ("license: mit or " * 50_000, "-only" * 100_000, "license: " + "(" * 100_000, "a" * 1_000_000):
        licenses.scan(("spdx-license-identifier: " + text).encode())


# -- spelling ------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    forms, many = {}, {}
    for w in words:
        some = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        many[w] = len(some)
        best = min(some, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (words[w], forms[w], words.get(forms[w]), root, many[w])
    return out


def test_variants_by_brute_force(docs, real, empty):
    for frame in (docs, real):
        rows = spelling.variants(frame).collect()
        got = {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in rows}
        assert len(got) == len(rows) > 0
        assert got == plain_variants(table(frame))
    assert spelling.variants(empty).count() == 0


def test_long_words_by_digest(monkeypatch, docs):
    monkeypatch.setattr(spelling, "LONGEST_KEY", 6)
    random.seed(9)
    words = sorted({"".join(random.choices("ab", k=random.randint(5, 9))) for _ in range(300)})
    groups = defaultdict(list)
    for i, w in enumerate(words):
        for key, skips, first in spelling.rotations(w):
            groups[key].append((skips, first, i, 7 * i % 50))
    many, best = Counter(), {}
    for members in groups.values():
        for i, n_near, n, other in spelling.scan_group(members):
            many[i] += n_near
            best[i] = max(best.get(i, (-1, 0)), (n, -other))
    for i, w in enumerate(words):
        some = [j for j, v in enumerate(words) if near(w, v)]
        assert many[i] == len(some)
        assert best.get(i) == max(((7 * j % 50, -j) for j in some), default=None)


def test_variants_match_reference_sql(spark):
    name = "op12_permuterm_variants"
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).sql(queries.ORACLE_SQL[name]).df()
    assert_same(got.astype({"form_n": "Int64"}), want.astype({"form_n": "Int64"}))


# -- resampling ----------------------------------------------------------------------


def plain_ranks(rows, target, runs=1, buckets=10_000, least=20, percent=10):
    def found(text):
        words = WORD.findall(lowered(text))
        grams = [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    own = [(doc_id, *found(text)) for doc_id, text in rows]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for text in target for b in found(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, n, f in own:
        total = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f
        )
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([n, doc_id, len(f), weight, score, None])
    fit = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[3], x[2]))
    for at, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = at
    return sorted((repr(tuple(x[1:])) for x in out))


FIELDS = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("options", [{}, {"runs": 3, "buckets": 512, "least_words": 2, "percent": 50}])
def test_ranks_by_brute_force(spark, docs, real, empty, options):
    target = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    texts = [r.text for r in target.collect()]
    plain = {"least" if k == "least_words" else k: v for k, v in options.items()}
    for frame, goal, goal_texts in ((docs, target, texts), (real, target, texts), (docs, empty, [])):
        got = resampling.ranked(frame, goal, **options).collect()
        assert sorted(repr(tuple(r[f] for f in FIELDS)) for r in got) == plain_ranks(table(frame), goal_texts, **plain)
    assert resampling.ranked(empty, target, **options).count() == 0


def test_blocks_mask_ngrams_across_texts(monkeypatch):
    texts = ["a b c", "", "d", "e f\x00g", "h " * 50]
    seen = {}
    for size in (1, 8, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", size)
        per_text = {}
        for first, block in resampling.blocks(pa.array([t.encode() for t in texts], pa.binary())):
            words, of, bucket = resampling.features(block, 3, 1 << 32)
            for i in range(len(block)):
                per_text[first + i] = (int(words[i]), sorted(bucket[of == i].tolist()))
        seen[size] = per_text
    assert seen[1] == seen[8] == seen[1 << 20]
    assert seen[1][0][1] == sorted(zlib.crc32(g) for g in (b"a", b"b", b"c", b"a b", b"b c", b"a b c"))


def test_resampled_rows_keep_their_columns(spark, docs, real, empty):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    for frame in (docs, real):
        drawn = resampling.resampled(frame, target, percent=50)
        ranks = resampling.ranked(frame, target, percent=50).where("rank is not null")
        assert drawn.columns == frame.columns
        # Repeated rows come along with the last one drawn.
        assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in ranks.collect()}
    assert drawn.count() == ranks.count() and drawn.subtract(real).count() == 0
    assert resampling.resampled(empty, target).columns == empty.columns


def test_ranks_match_reference_sql(spark):
    name = "op13_batch_resampling"
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).sql(queries.ORACLE_SQL[name]).df()
    assert_same(got.astype({"rank": "Int64"}), want.astype({"rank": "Int64"}))


def test_weights_favour_the_target():
    gain = resampling.gains(np.array([90, 5, 5]), np.array([1, 98, 1]))
    assert gain[1] > 0 > gain[0]
