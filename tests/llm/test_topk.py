"""Top-k against all inner products, with ties, odd vectors, large numbers and small blocks."""

import math
import random

import pytest

from auditloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, rank int, score long, v string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1, "clash") for i, v in vectors], SCHEMA)


def brute(vectors, k=5):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(256 * x) for x in v]
            whole[i] = min(whole.get(i, ints), ints)
    out = []
    for q, a in whole.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, width=8, steps=4, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.randint(-steps, steps) / 4 for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("steps", "block", "query_block"), [(4, 4096, 256), (1, 64, 2), (400, 40, 3)])
def test_equals_brute_force(spark, steps, block, query_block):
    given = vectors(400, steps=steps) + [(10_050, None), (10_100, [None] * 8), (10_150, [float("nan")] * 8), (None, [1.0] * 8),
                                         (11_000, [float("inf")] * 8), (12_000, []), (12_050, [1.0, 2.0]), (3, [9.0] * 8), (50, [0.0] * 8)]
    rows = topk.scaled(frame(spark, given), topk.F.col("embedding"))
    got = topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5, block, query_block)
    assert sorted(map(tuple, got.collect())) == brute(given)


def test_one_vector_in_most_rows(spark):
    given = [(i, [0.5, -0.25] if i % 3 else [i / 1000, 0.125]) for i in range(900)]
    assert sorted(map(tuple, topk.search_table(frame(spark, given)).collect())) == brute(given)


def test_few_rows_none_and_large_numbers(spark):
    for given in ([(0, [1.0]), (1, [2.0]), (7, [2.0])], [(0, [1.0])], [], [(0, [3e6, -2e6]), (1, [2.5e6, 1e6]), (2, [1e6, 3e6])]):
        assert sorted(map(tuple, topk.search_table(frame(spark, given)).collect())) == brute(given)


def test_reading_stops_early():
    import numpy as np

    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, (4000, 2))
    values[:6] = 10_000 + np.arange(12).reshape(6, 2)
    lists, reads = topk.Lists(np.arange(4000), values), []
    sort = topk.np.ceil
    try:
        topk.np.ceil = lambda x: reads.append(x) or sort(x)
        found = list(lists.search(np.array([-1]), np.array([[1, 1]]), 5))
    finally:
        topk.np.ceil = sort
    assert found[0][1].tolist() == [5, 4, 3, 2, 1] and len(reads) == 1
