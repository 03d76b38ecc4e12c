"""Schedules: every block in its window, less than one block off target, whole results."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from auditloom.llm import mixing
from tests.llm.tables import documents, nothing, rows


@pytest.mark.parametrize("counts", [[1], [3, 1], [5, 3, 2], [1, 1, 1, 1], [37, 11, 7, 1, 1], [120, 60, 59, 1]])
def test_blocks_lie_in_their_windows(spark, counts):
    order = spark.createDataFrame([(counts,)], "c array<int>").select(mixing.edf(F.col("c"))).first()[0]
    total, done = sum(counts), [0] * len(counts)
    assert len(order) == total
    for slot, i in enumerate(order):
        k = done[i]
        assert k * total // counts[i] <= slot < -(-(k + 1) * total // counts[i])
        done[i] += 1
        for n, c in zip(done, counts):
            assert abs(n - Fraction((slot + 1) * c, total)) < 1
    assert done == counts


@pytest.mark.parametrize("seed", range(4))
def test_rounds_as_sources_run_out(spark, seed):
    rng = random.Random(seed)
    given = [(f"s{k}", rng.randint(1, 9), rng.randint(1, 90)) for k in range(rng.randint(1, 6))]
    kinds = mixing.rounds(spark.createDataFrame(given, "source string, weight int, blocks long")).collect()
    slots = {}
    for source, weight, blocks in given:
        for block in range(blocks):
            hits = [k.start + (block // weight - k.first_round) * k.length + k.place for k in kinds
                    if k.source == source and k.nth == block % weight and k.first_round <= block // weight < k.last_round]
            assert len(hits) == 1
            slots[hits[0]] = source
    total = sum(b for *_, b in given)
    assert sorted(slots) == list(range(total))
    # Until the first source ends, every prefix is less than one block off target.
    period, whole = sum(w for _, w, _ in given), min(b // w for _, w, b in given)
    for source, weight, _ in given:
        n = 0
        for slot in range(whole * period):
            n += slots[slot] == source
            assert abs(n - Fraction((slot + 1) * weight, period)) < 1


def test_documents_keep_their_rows_and_order(spark):
    weights = spark.createDataFrame([("s0", 3), ("s1", 1), ("gone", 9)], "source string, weight int")
    docs = documents(spark)
    got = mixing.mix(docs, weights, block_bytes=500).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source) for r in got) == sorted((r[0] is None, r[0] or 0, r[3] or "") for r in rows())
    for source in {r.source for r in got}:
        own = sorted((r for r in got if r.source == source), key=lambda r: r.before)
        at = 0
        for r in own:
            assert r.before == at and r.block == at // 500
            at += r.size
        assert [r.slot for r in own] == sorted(r.slot for r in own)
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})
    assert mixing.mix(nothing(spark)).collect() == []


def test_layout_follows_the_slots(spark):
    docs = documents(spark)
    laid = mixing.in_mixed_order(docs, block_bytes=500)
    assert laid.columns == docs.columns and laid.count() == docs.count()
    slots = {}
    for r in mixing.mix(docs, block_bytes=500).collect():
        slots.setdefault((r.doc_id, r.source, r.size), set()).add(r.slot)
    seen = [min(slots[(r.doc_id, r.source or "", len((r.text or "").encode()) + 1)]) for r in laid.collect()]
    assert seen == sorted(seen)
    assert mixing.in_mixed_order(nothing(spark)).count() == 0
