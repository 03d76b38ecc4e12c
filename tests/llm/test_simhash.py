"""Fingerprints bit by bit, links and components against all pairs, and the stage that keeps one of each."""

import random

import numpy as np
import pytest
import xxhash

from auditloom.llm import simhash
from auditloom.llm.components import components
from tests.llm.tables import documents, nothing, rows, words


def plain(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(lower)
    parts = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Least member of each fingerprint's component, by all pairs."""
    nodes = sorted(set(prints))
    of = {n: n for n in nodes}
    for _ in nodes:
        before = dict(of)
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 2:
                    of[a] = of[b] = min(of[a], of[b])
        if of == before:
            break
    return of


def test_rows_equal_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    given = rows()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in got) == sorted(
        (r[0] is None, r[0] or 0, plain(r[1])) for r in given)
    of, least = groups([plain(r[1]) for r in given]), {}
    for doc_id, text, *_ in given:
        if doc_id is not None:
            root = of[plain(text)]
            least[root] = min(doc_id, least.get(root, doc_id))
    assert all(r.component_id == least[of[r.fp % 2**64]] for r in got)
    assert simhash.near_duplicates(nothing(spark)).collect() == []


@pytest.mark.parametrize("tile", [2048, 3])
def test_links_connect_all_within_the_radius(spark, tile):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):  # chains of two-bit steps, and lone ones
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9])):
            prints.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    prints |= {0, 1, 3, 2**64 - 1, 2**64 - 2}
    signed = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = simhash.links_between(signed, tile=tile)
    roots = {r.node % 2**64: r.root for r in components(links).collect()}
    of = groups(prints)
    for a in prints:
        for b in prints:
            assert (of[a] == of[b]) == (roots.get(a, a) == roots.get(b, b))
    assert links.count() <= 60 * len(prints)


def test_components_of_a_path_a_star_and_noise(spark):
    pairs = [(k, k + 1) for k in range(100, 163)] + [(5, k) for k in range(10, 60)] + [(3, 3), (7, 8), (8, 7), (7, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 164), 100), **dict.fromkeys([5, *range(10, 60)], 5), 7: 7, 8: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_keeps_the_first_and_all_columns(spark):
    docs = documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    given, of = rows(), groups([plain(r[1]) for r in rows()])
    firsts = {}
    for doc_id, text, *_ in given:
        root = of[plain(text)]
        firsts[root] = min(firsts.get(root, (True, 0)), (doc_id is None, doc_id or 0))
    got = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(firsts.values())
