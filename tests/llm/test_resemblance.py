"""The pipeline's near-duplicate stage against Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import resemblance
from tests.llm.tables import documents, nothing, prose, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def stays(given):
    """doc_ids of the first of each component, by all pairs."""
    sets = sorted({plain_set(t) for _, t, *_ in given}, key=sorted)
    root = list(range(len(sets)))

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, x in enumerate(sets):
        for b in range(a):
            both = len(x & sets[b])
            if both and 5 * both >= 4 * len(x | sets[b]):
                root[top(a)] = top(b)
    of, least = {s: top(k) for k, s in enumerate(sets)}, {}
    for d, t, *_ in given:
        group = of[plain_set(t)]
        least[group] = min(least.get(group, (True, 0)), (d is None, d or 0))
    return sorted(least.values())


def near_copies(seed=5):
    """Texts with some words changed, about the similarity on both sides; one group is large."""
    rng, out = random.Random(seed), []
    for _ in range(12):
        first = prose(rng, rng.choice([25, 120, 400])).split(" ")
        for _ in range(40 if not out else 4):
            copy = list(first)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 35))):
                copy[at] = prose(rng, 1, "xyz") + "q"
            out.append((len(out), " ".join(copy), "en", "s", 1))
    return out


@pytest.mark.parametrize("given", [rows(), near_copies()], ids=["odd", "near"])
def test_stage_equals_all_pairs(spark, given):
    docs = documents(spark, given)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == stays(given)


def linked(spark, given):
    """Root of every distinct set by the stage's links, and by all pairs."""
    docs = documents(spark, given).select("doc_id", "text")
    nodes = resemblance.written(resemblance._nodes(resemblance._marks(docs, 5)))[0]
    found = {(r.a, r.b) for r in resemblance.links(docs, nodes).collect()}
    of = {r.node: r["first"].doc_id for r in nodes.collect()}
    sets = {d: plain_set(t) for d, t, *_ in given}
    pairs = {(x, y) for x in of.values() for y in of.values() if x < y
             and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}

    def roots(edges):
        root = {d: d for d in of.values()}

        def top(k):
            return k if root[k] == k else top(root[k])
        for x, y in edges:
            root[top(max(x, y))] = top(min(x, y))
        return {d: top(d) for d in root}

    return {tuple(sorted((of[a], of[b]))) for a, b in found}, pairs, roots


def changed(rng, first, changes):
    copy = list(first)
    for at in rng.sample(range(len(copy)), changes):
        copy[at] = prose(rng, 1, "xyz") + str(rng.randrange(10**9))
    return " ".join(copy)


def test_recall_of_pairs_that_stand_alone(spark):
    """Pairs at similarities from just above 0.8: at least nine tenths are found, and nothing below is linked."""
    rng, given = random.Random(3), []
    for _ in range(150):
        first = prose(rng, 200).split(" ")
        for text in (" ".join(first), changed(rng, first, rng.randint(1, 5))):
            given.append((len(given), text, "en", "s", 1))
    found, pairs, _ = linked(spark, given)
    assert len(pairs) > 80 and found <= pairs and len(found) >= 0.9 * len(pairs)


def test_large_group_around_the_similarity_is_joined(spark, monkeypatch):
    """Copies of one text, many pairs on both sides of the similarity, in blocks far smaller than the group."""
    rng = random.Random(6)
    first = prose(rng, 150).split(" ")
    given = [(k, changed(rng, first, rng.randint(0, 3)), "en", "s", 1) for k in range(500)]
    found, pairs, roots = linked(spark, given)
    assert found <= pairs
    want, got = roots(pairs), roots(found)
    joined = [d for d, r in want.items() if r != d]
    assert sum(got[d] != d for d in joined) >= 0.9 * len(joined)


def test_candidates_do_not_grow_with_the_square_of_a_group(spark):
    """Texts that share most words but never reach the similarity, the case of all pairs of a group."""
    rng, counts = random.Random(9), []
    common = prose(rng, 40)
    for n in (200, 400):
        given = [(k, f"{common} {' '.join(f'w{k}x{i}' for i in range(6))}", "en", "s", 1) for k in range(n)]
        docs = documents(spark, given).select("doc_id", "text")
        nodes, _ = resemblance.written(resemblance._nodes(resemblance._marks(docs, 5)))
        counts.append(resemblance.candidates(nodes).count())
    assert counts[0] <= resemblance.TREES * 200 * 1.1 and counts[1] <= 2.5 * max(counts[0], 100)


def test_the_copies_of_the_review_go(spark):
    given = [(r.doc_id, r.text, r.lang, r.source, 1) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
             .where("doc_id IN (1, 255, 278, 643, 770)").collect()]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, given), "").collect()
    assert sorted((False, r.doc_id) for r in got) == stays(given) and len(got) < len(given)


def test_shingles_are_sets_of_five_words():
    texts = [t or "" for _, t, *_ in rows()]
    doc, hashes = resemblance.shingles(texts)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(plain_set(t)) for t in texts]


def test_no_rows(spark):
    assert corpus_pipeline.near_duplicates(spark, nothing(spark), "").collect() == []


def test_pairs_a_block_leaves_out_are_compared(spark, monkeypatch):
    """A group far larger than a block whose links lie in few pairs: no component of pairs that meet is left apart."""
    monkeypatch.setattr(resemblance, "TILE", 5)
    rng, given = random.Random(21), []
    common = prose(rng, 60)
    for k in range(150):  # pairs of one k are linked, others share most words and are not
        own = " ".join(f"w{k}x{i}" for i in range(12))
        given += [(2 * k, f"{common} {own}", "en", "s", 1), (2 * k + 1, f"{common} {own} last{k}", "en", "s", 1)]
    docs = documents(spark, given).select("doc_id", "text")
    nodes, _ = resemblance.written(resemblance._nodes(resemblance._marks(docs, 5)))
    none = nodes.select("node", F.col("node").alias("root")).limit(0)
    of = {r.node: r["first"].doc_id for r in nodes.collect()}
    firsts = {of[r.node]: {r["keys"][t * len(resemblance.LEVELS)] for t in range(resemblance.TREES)} for r in nodes.collect()}
    sets = {d: plain_set(t) for d, t, *_ in given}
    want = {(x, y) for x in sets for y in sets if x < y and firsts[x] & firsts[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    assert len(want) >= 100
    got = [tuple(sorted((of[r.a], of[r.b]))) for r in resemblance.missed_links(docs, nodes, none).collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(resemblance, "links", lambda docs, nodes, width: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    roots = {of[r.node]: r.root for r in resemblance.classes(docs, nodes).collect()}
    assert all(roots[x] == roots[y] for x, y in want)
    joined = resemblance.components(nodes.select(F.lit(nodes.first().node).alias("a"), F.col("node").alias("b")))
    assert resemblance.missed_links(docs, nodes, joined).count() == 0
