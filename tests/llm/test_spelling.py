"""Single edits against an edit distance over all pairs, whatever the tiles; forms and roots against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from auditloom.llm import spelling
from tests.llm.tables import documents, nothing

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain(rows):
    n = Counter()
    for d, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], -1), root(w)) for w in n)


def texts(seed=8):
    """Words in chains of single edits, some far more frequent, letters beyond ASCII, and a run of 3,000 letters."""
    rng, out = random.Random(seed), []
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 14))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "AAAAAAAAA", "x" * 3000]
    for stem in stems:
        family = [stem]
        for _ in range(12):
            w, k = rng.choice(family), rng.randrange(len(family[0]))
            family.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abÉ") + w[k:], w[:k] + "z" + w[k + 1:]]))
        for j, w in enumerate(family):
            out += [w] * rng.choice([1, 2, 3, 25, 400 if j == 0 else 2])
    rng.shuffle(out)
    return [(k, " ".join(out[k::40]), "en", "s", 1) for k in range(40)] + [(None, "Aaaaaaa, aaaaaaa; ÷×éèêëìíî", "en", "s", 1), (77, None, None, None, None),
                                                                              (78, "", "en", "s", 0), (79, "aaaaaab " * 3, "en", "s", 1), (79, "aaaaaab " * 3, "en", "s", 1)]


def collected(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in df.collect())


def test_variants_equal_all_pairs(spark):
    rows = texts()
    assert collected(spelling.variants(documents(spark, rows))) == plain(rows)


@pytest.mark.parametrize("tile, matrix", [(3, 2), (5, 5), (512, 128)])
def test_pairs_whatever_the_tiles(spark, monkeypatch, tile, matrix):
    monkeypatch.setattr(spelling, "MATRIX", matrix)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    got = spelling.near(spark.createDataFrame([(w,) for w in words], "word string"), tile).collect()
    assert len(got) == len({frozenset(r) for r in got})
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_wide_words_take_small_matrices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 64)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(12)) for _ in range(150)})
    got = spelling.near(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_no_words(spark):
    assert spelling.variants(nothing(spark)).collect() == []
    assert spelling.variants(documents(spark, [(1, "short words only", "en", "s", 1)])).collect() == []
