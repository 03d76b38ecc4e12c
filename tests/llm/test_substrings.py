"""Removed words and kept texts against a brute-force index of all windows."""

from collections import defaultdict

import pytest

from auditloom.llm import substrings
from tests.llm.tables import documents, nothing, rows, words


def brute(given, window):
    ids = defaultdict(set)
    for doc_id, text, *_ in given:
        w = words(text)
        for k in range(len(w) - window + 1):
            if doc_id is not None:
                ids[tuple(w[k:k + window])].add(doc_id)
    out = []
    for doc_id, text, *_ in given:
        w, gone = words(text), set()
        for k in range(len(w) - window + 1):
            if doc_id is not None and min(ids[tuple(w[k:k + window])]) < doc_id:
                gone.update(range(k, k + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "chunk_bytes", "bucket_words"), [(13, 4 << 20, 2 << 20), (13, 3000, 500), (5, 3000, 200), (12, 9000, 500)])
def test_equals_brute_force(spark, window, chunk_bytes, bucket_words):
    got = substrings.remove_repeats(documents(spark), window, chunk_bytes, bucket_words)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), window)


def test_one_passage_in_every_document_and_self_repeats(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    given = [(k, f"a{k} {passage} {passage} b{k}", "en", "s", 1) for k in range(200)]
    got = substrings.remove_repeats(documents(spark, given), chunk_bytes=20_000, bucket_words=1000).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(k, 120 if k else 0) for k in range(200)}


def test_no_rows(spark):
    assert substrings.remove_repeats(nothing(spark)).collect() == []
