"""Words left out of the model stay unreported, random strings are found; costs with and without a limit."""

import re
import string
from random import Random
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.letters import LetterModel, corpus_triples, triples_of
from auditloom.llm.secrets_scan import CONTEXT, GuessCost, all_spans, learnt_triples
from tests.llm.tables import documents, nothing

DOCS = "/root/testdata/sf0.01/documents.parquet"


def words_of(text):
    return {w for w in re.split(r"[^\w]+|_", (text or "").lower()) if re.fullmatch("[a-zß-öø-ÿ]{3,24}", w)}


@pytest.fixture(scope="module")
def by_language():
    found, seen = {}, {}
    for r in pq.read_table(DOCS, columns=["lang", "text"]).to_pylist():
        for w in words_of(CONTEXT.sub(" ", r["text"] or "")):
            seen[w] = seen.get(w, 0) + 1
            found.setdefault(r["lang"], set()).add(w)
    return {lang: sorted(w for w in ws if seen[w] > 1) for lang, ws in found.items()}


@pytest.fixture(scope="module")
def scorer(by_language):
    return GuessCost(triples=triples_of(w for ws in by_language.values() for w in ws if crc32(w.encode()) % 5))


def reported(scorer, values):
    return sum(any(k == "guess" for k, _, _ in all_spans(f"passphrase: {v} then", scorer, 8, 8)) for v in values) / len(values)


def test_held_out_words_are_left_alone(by_language, scorer):
    assert len(by_language) == 4
    for words in by_language.values():
        held = [w for w in words if len(w) >= 8 and crc32(w.encode()) % 5 == 0]
        assert len(held) > 200
        assert reported(scorer, held) <= 0.02
        assert reported(scorer, [w.capitalize() for w in held]) <= 0.02


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits])
@pytest.mark.parametrize("length", [8, 12, 20, 40])
def test_random_strings_are_found(scorer, letters, length):
    draw = Random(length)
    assert reported(scorer, ["".join(draw.choice(letters) for _ in range(length)) for _ in range(500)]) >= 0.98


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "1987", "-05-", "qwer", "aaa", "Zx", "9", "dragon", "!", "verant", "kj"]), max_size=7).map("".join))
def test_a_limit_changes_no_cost_below_it(value):
    whole = GuessCost().cost(value)
    for limit in (2.0, 5.0, 8.0):
        assert GuessCost().cost(value, limit) == (pytest.approx(whole) if whole < limit else limit)


def test_chances_of_a_context_add_up_to_one():
    model = LetterModel(triples_of(["house", "mouse", "hose", "über"]))
    ends = [*"abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ$"]
    assert sum(model.chance("ho" + c) for c in ends) == pytest.approx(1, abs=0.01)


def test_counted_triples_equal_plain(spark):
    texts = ["House hose pwd: KxQvTzLmWpRbNdHs", "house, HOSE! über_all x2y " + "z" * 30, "über all pwd: KxQvTzLmWpRbNdHs", None, "", "once"]
    docs = documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    assert learnt_triples(docs) == dict(triples_of(["house", "hose", "über", "all"]))
    assert corpus_triples(nothing(spark), "x") == {}


def test_words_as_the_table_has_them(spark, by_language):
    got = learnt_triples(spark.read.parquet(DOCS))
    assert got == dict(triples_of(w for ws in by_language.values() for w in ws))


def test_a_long_value_ends_early():
    draw = Random(5)
    value = "".join(draw.choice(string.ascii_letters) for _ in range(300_000))
    assert reported(GuessCost(), [value]) == 1
