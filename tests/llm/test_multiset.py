"""Multiset fingerprints against plain Python, their laws, and how likeness follows what texts share."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.llm import multiset
from tests.llm.tables import documents, nothing, prose, rows

BLOCK = re.compile(r"[^ \t\n\x0b\f\r]+(?:[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]+){0,3}")


def plain(text):
    lanes = [0] * 81
    for p in (text or "").split("\n"):
        for salt in (0, 1):
            digest = hashlib.sha256(f"{salt}:{p}".encode()).hexdigest()
            for k in range(8):
                lanes[1 + 8 * salt + k] += int(digest[8 * k:8 * k + 8], 16)
        for block in BLOCK.findall(p):
            bits = int(hashlib.md5(block.encode()).hexdigest()[:16], 16)
            lanes[0] += 1
            for k in range(64):
                lanes[17 + k] += bits >> k & 1
    return [x % 2**32 for x in lanes]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * s - v[0] for s in v[17:]] for v in (a, b))
    total = sum(s * s for s in x) + sum(s * s for s in y)
    return max(0.0, 1 - sum((s - t) ** 2 for s, t in zip(x, y, strict=True)) / total) if total else 0.0


def of(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    return [r.print for r in multiset.fingerprints(frame, ["k"]).orderBy("k").collect()]


@pytest.fixture(scope="module")
def compared(spark):
    return multiset.compare_next(documents(spark)).collect()


def test_rows_equal_plain_python(compared):
    order = sorted(((d is None, d or 0, hashlib.sha256((t or "").encode()).digest(), t or "") for d, t, *_ in rows()))
    want = []
    for k, (none, d, _, text) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        part = len(text) // 4
        edited = text[:len(text) - part] + after[:part]
        a, b, c = plain(text), plain(edited), plain(after)
        want.append((None if none else d, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.print, r.edited_print, r.near_edited, r.near_next) for r in compared]

    def key(r):
        return (r[0] is None, r[0] or 0, r[2])

    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-12)


def test_single_row_is_its_own_next(spark):
    one = multiset.compare_next(documents(spark, [(5, "a b c d e f g h", "en", "s", 1)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()


def test_no_rows(spark):
    assert multiset.compare_next(nothing(spark)).collect() == []


def test_paragraphs_in_any_order_added_and_taken_away(spark):
    rng = random.Random(2)
    parts = [prose(rng, rng.randint(0, 30)) for _ in range(12)] + ["same", "same", ""]
    shuffled = rng.sample(parts, len(parts))
    a, b, fewer, one = of(spark, ["\n".join(parts), "\n".join(shuffled), "\n".join(parts[:-3]), "\n".join(parts[-3:])])
    assert a == b != fewer
    got = spark.createDataFrame([(a, fewer, one)], "a array<long>, b array<long>, c array<long>").select(
        multiset.plus(F.col("b"), F.col("c")), multiset.minus(F.col("a"), F.col("c"))).first()
    assert (got[0], got[1]) == (a, fewer)


def test_repeats_count_and_spaces_matter(spark):
    prints = of(spark, ["x\nx", "x", "x ", "", None, "\n", "x\n\n"])
    assert prints[3] == prints[4]
    assert max(Counter(tuple(p) for p in prints).values()) == 2


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(60):
        lines = [prose(rng, 24) for _ in range(20)]
        for kept in (20, 15, 10, 0):
            pairs.append((kept, "\n".join(lines), "\n".join(lines[:kept] + [prose(rng, 24) for _ in range(20 - kept)])))
    prints = of(spark, [t for _, a, b in pairs for t in (a, b)])
    by = {}
    for k, (kept, *_) in enumerate(pairs):
        by.setdefault(kept, []).append(plain_likeness(prints[2 * k], prints[2 * k + 1]))
    mean = {kept: sum(v) / len(v) for kept, v in by.items()}
    assert mean[20] == 1 and abs(mean[15] - 0.75) < 0.03 and abs(mean[10] - 0.5) < 0.05 and mean[0] < 0.12
    assert max(by[0]) < min(by[15])
