"""Measures against plain Python, the binomial tail against exact fractions, cutoffs against their definition."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from auditloom.llm import quality
from tests.llm.tables import documents, nothing, prose, rows, words


def plain(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [line for line in text.split("\n") if words(line)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_lines": len(lines), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_repeat_words": len(covered)}


def test_measures_equal_plain(spark):
    rng = random.Random(5)
    loop = prose(rng, 11)
    given = rows() + [(5000 + n, " ".join([loop] * n) + " tail " + "a " * n, "en", "s", 1) for n in range(1, 12)]
    got = documents(spark, given).select("doc_id", "text", quality.measures(F.col("text")).alias("measured")).collect()
    for r in got:
        assert r.measured.asDict() == plain(r.text)


@pytest.mark.parametrize(("n", "x", "p"), [(10, 0, 0.1), (50, 3, 0.05), (2000, 4, 0.005), (30000, 100, 0.005), (5, 5, 0.3)])
def test_tail_is_exact(spark, n, x, p):
    got = spark.createDataFrame([(n, x)], "n long, x long").select(quality.log_tail(F.col("n"), F.col("x"), p)).first()[0]
    q = Fraction(p)
    exact = sum(math.comb(n, j) * q**j * (1 - q)**(n - j) for j in range(x + 1)) if n <= 2000 else None
    if exact is not None:
        assert got == pytest.approx(math.log(exact), abs=1e-9)
    else:
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(x + 1)]
        top = max(logs)
        assert got == pytest.approx(top + math.log(sum(math.exp(v - top) for v in logs)), rel=1e-9)


def labelled(n, bad):
    """Good prose, of which few have symbols, and bad texts full of them; and a small stratum."""
    rng = random.Random(2)
    texts = []
    for k in range(n):
        text = prose(rng, 30)
        junk = k % 10 == 0
        if junk or k % 1000 == 1:
            text = " ".join(w + " ##" for w in text.split())
        texts.append((k, text, "en" if k < n - 50 else "xx", "s", 1, 0 if junk and bad else 1))
    return texts


def test_cutoffs_hold_their_guarantee(spark):
    given = labelled(6000, bad=True)
    docs = documents(spark, [g[:5] for g in given])
    labels = spark.createDataFrame([(g[0], g[5], 0, "x") for g in given] + [(77, 1, 0, "x"), (None, 1, 0, "x"), (10**6, 0, 0, "x")],
                                   "doc_id long, quality int, toxic int, kept string")
    got = quality.quality(docs, labels, risk=0.04, error=0.05).collect()
    assert len(got) == len(given)
    kept = {r.doc_id: r.kept for r in got}
    good = [g for g in given if g[5] == 1]
    assert not any(kept[g[0]] for g in given if g[5] == 0 and g[2] == "en")
    assert sum(not kept[g[0]] for g in good) <= 0.04 * len(good)
    assert all(kept[g[0]] for g in given if g[2] == "xx")  # too few labels to certify anything
    # If good documents look like the bad ones, nothing may be rejected.
    none = quality.quality(docs, labels.withColumn("quality", F.lit(1)), risk=0.04, error=0.05)
    assert none.where("not kept and not base_failed").count() == 0


def test_awkward_rows_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(documents(spark), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got) == sorted(
        (d is None, d or 0, not (plain(t)["n_words"] < 20 or 100 * plain(t)["n_repeat_words"] > 30 * plain(t)["n_words"])) for d, t, *_ in rows())
    assert quality.quality(nothing(spark), labels).collect() == []


def test_no_python_on_the_main_path(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.quality(documents(spark), labels)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
