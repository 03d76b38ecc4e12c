"""Base score against plain Python; the model is a distribution and beats the base on held-out texts."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import chunks, maxent
from tests.llm.tables import documents, nothing, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*words((text or "").translate(LOWER)), None]


def base(given):
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(t for d, x, *_ in given if not out(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(d, out(d), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n,
             sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for d, x, *_ in given]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("bucket_tokens", [8 << 20, 2000])
def test_base_equals_plain(spark, monkeypatch, bucket_tokens):
    monkeypatch.setattr(maxent, "BUCKET_TOKENS", bucket_tokens)
    got = by_row(map(tuple, maxent.language_model_scores(documents(spark)).collect()))
    for g, w in zip(got, by_row(base(rows())), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and math.isfinite(g[6]) and g[6] < 0


def speech(seed, n=900):
    """Two languages with words of their own; the language is only told by what came before."""
    rng = random.Random(seed)
    voices = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(150)] for letters in ("abcde", "vwxyz")]
    return [(k, " ".join(rng.choice(voices[k % 2]) for _ in range(60)), "en", "s", 1) for k in range(n)]


def test_model_beats_the_base_on_held_out_texts(spark):
    got = [r for r in maxent.language_model_scores(documents(spark, speech(1))).collect() if r.held_out]
    gain = [(r.score - r.base_score) / r.n_tokens for r in got]
    assert len(got) > 50 and np.mean(gain) > 0.1 and np.mean([g > 0 for g in gain]) > 0.95


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch, tmp_path):
    """The same documents as one file and as twelve, in other orders, with several shards and rounds."""
    monkeypatch.setattr(maxent, "dealt", lambda docs: chunks.dealt(docs, 20_000))
    monkeypatch.setattr(maxent, "CHUNK_BYTES", 20_000)
    given, scores = speech(3, 300), []
    for files in (1, 12):
        path = str(tmp_path / str(files))
        documents(spark, random.Random(files).sample(given, len(given))).select("doc_id", "text").repartition(files).write.parquet(path)
        scores.append({r.doc_id: (r.base_score, r.score) for r in maxent.language_model_scores(spark.read.parquet(path)).collect()})
    assert scores[0].keys() == scores[1].keys()
    for d, pair in scores[0].items():
        assert pair == pytest.approx(scores[1][d], abs=1e-6)


def test_training_equals_a_plain_model(spark, monkeypatch):
    """Weights of one shard and one batch against a softmax regression written out token by token."""
    given = speech(5, 12)
    docs = documents(spark, given)
    rows, size = chunks.dealt(docs)
    classes = np.arange(maxent.SUFFIXES) % maxent.CLASSES
    bias = np.zeros(maxent.CLASSES, np.float32)
    got = maxent.train(rows, 1, classes, bias)
    texts = [t for d, t, *_ in sorted(given) if not maxent.held_out(d)]
    seen = maxent.Tokens(texts)
    features, target = seen.features(), classes[seen.suffix]
    assert len(target) <= maxent.BATCH  # one step
    slope = np.zeros((maxent.FEATURES, maxent.CLASSES))
    for line, c in zip(features, target, strict=True):
        wrong = np.full(maxent.CLASSES, 1 / maxent.CLASSES)  # all weights and the bias are zero
        wrong[c] -= 1
        for f in line:
            slope[f] += wrong
    want = -maxent.RATE * slope / np.sqrt(1e-2 + slope**2)
    assert np.allclose(got, want, atol=1e-5)


def plain_step(weights, squares, met, texts, classes, bias, shuffle):
    """The step written out: every feature's slopes summed by themselves."""
    seen = maxent.Tokens(texts)
    features, target = seen.features(), classes[seen.suffix]
    shuffled = shuffle.permutation(len(target))
    for at in range(0, len(target), maxent.BATCH):
        rows = shuffled[at:at + maxent.BATCH]
        logits = bias + weights[features[rows, 0]]
        for k in range(1, maxent.KINDS):
            logits += weights[features[rows, k]]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = odds / odds.sum(axis=1, keepdims=True)
        slope[np.arange(len(rows)), target[rows]] -= 1
        flat = features[rows].ravel()
        by_feature = np.argsort(flat, kind="stable")
        own, first, n = np.unique(flat[by_feature], return_index=True, return_counts=True)
        sums = np.add.reduceat(slope[by_feature // maxent.KINDS], first, axis=0)
        squares[own] += sums * sums
        weights[own] -= maxent.RATE * sums / np.sqrt(squares[own])
        met[own] += n


def test_a_step_is_the_plain_one_at_two_thirds_of_its_cost():
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    texts = [" ".join(common[int(4000 * rng.random() ** 3)] for _ in range(400)) for _ in range(150)]  # features met once to often
    classes, bias = np.arange(maxent.SUFFIXES) % maxent.CLASSES, np.linspace(-1, 1, maxent.CLASSES, dtype=np.float32)

    def run(step):
        state = [np.zeros((maxent.FEATURES, maxent.CLASSES), np.float32), np.full((maxent.FEATURES, maxent.CLASSES), 1e-2, np.float32),
                 np.zeros(maxent.FEATURES, np.int64)]
        began = time.thread_time()
        step(*state, texts, classes, bias, np.random.default_rng(3))
        return time.thread_time() - began, state

    plain, now = ([run(step) for _ in range(5)] for step in (plain_step, maxent._step))
    for a, b in zip(plain[0][1], now[0][1], strict=True):
        assert np.array_equal(a, b)
    assert min(t for t, _ in now) < 2 / 3 * min(t for t, _ in plain)


@pytest.mark.parametrize("tokens_met", [1, 7, 8, 9, 10, 300])
def test_sums_by_feature_of_one_line_and_of_all_lines(tokens_met):
    rng = np.random.default_rng(tokens_met)
    slope = rng.normal(size=(tokens_met, maxent.CLASSES)).astype(np.float32)
    features = np.stack([np.full(tokens_met, k) for k in range(maxent.KINDS - 1)] + [1000 + np.arange(tokens_met)], axis=1).astype(np.uint16)
    own, n, sums = maxent._sums_by_feature(slope, features)
    got = {int(f): (int(c), s) for f, c, s in zip(own, n, sums, strict=True)}
    assert len(got) == len(own) == maxent.KINDS - 1 + tokens_met
    for k in range(maxent.KINDS - 1):
        assert got[k][0] == tokens_met and np.allclose(got[k][1], slope.sum(axis=0), atol=1e-4)
    for k in range(tokens_met):
        assert got[1000 + k][0] == 1 and np.array_equal(got[1000 + k][1], slope[k])


@pytest.mark.parametrize("block", [1, 5, 64])
def test_hashes_do_not_depend_on_the_block(monkeypatch, block):
    texts = ["", " \t\x0b a", "é" * 40 + " b\x0cc\rd\ne \x1c \x08f", "x y " * 30, " "]
    whole = chunks.Words([t.encode() for t in texts])
    monkeypatch.setattr(chunks, "HASHED_BYTES", block)
    cut = chunks.Words([t.encode() for t in texts])
    assert np.array_equal(whole.hashes, cut.hashes) and np.diff(whole.first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for t, h in zip([w for t in texts for w in words(t)], whole.hashes.tolist(), strict=True):
        assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    logs = maxent.log_softmax(rng.normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32),
                              np.zeros(maxent.CLASSES, np.float32), rng.integers(0, maxent.FEATURES, (50, maxent.KINDS)))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)
    counts = np.array([5, 0, 3, 2])  # of one class: the known ones and room for one unknown
    seen = counts[counts > 0]
    room = counts.sum() + maxent.SMOOTH * (len(seen) + 1)
    assert (seen + maxent.SMOOTH).sum() / room + maxent.SMOOTH / room == pytest.approx(1)


def test_no_rows_and_no_training_rows(spark):
    assert maxent.language_model_scores(nothing(spark)).collect() == []
    alone = maxent.language_model_scores(documents(spark, [(None, "a b", "en", "s", 1)])).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0 and alone[0].base_score == 0
