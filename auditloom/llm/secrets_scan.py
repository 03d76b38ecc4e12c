"""Secrets in texts: three fixed patterns, and credential values that would be hard to guess.

The guess cost of a value is the least sum of log10 guesses over all ways to cut it into known words
(with capitals and look-alike characters), words of no list, dates, repeats, keyboard walks and
brute-forced characters. It is found by dynamic programming over the matches. A run of letters counts as
a word of no list at the price of a vocabulary, and at as much more as a letter model, learnt from the
words of the corpus, finds it unlike its words. A value that follows a credential word is reported (kind
``guess``) when its cost reaches the threshold: weak or well-known values, and words of the languages
of the corpus, are left alone. The programme ends once no later state can cost less than the threshold.

Defined cases: a null or empty text has no spans; every row is scanned by itself, so repeated rows
and null ids need no care; texts and values of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain
from math import comb, inf, log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.letters import LONGEST, RUN, LetterModel, corpus_triples, triples_of
from auditloom.llm.plain_words import PLAIN

KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The three base patterns and the least lengths that count.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# Where a credential value is expected: an assignment, a header, the password of a URL.
CONTEXT = re.compile(
    r"(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|credentials?|auth(?:orization)?)[\"'`]?"
    r"[ \t]*(?::=|=>|[:=])[ \t]*(?:bearer[ \t]+|basic[ \t]+)?|\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*:(?=[^\s/@]+@))"
    r"[\"'`]?([^\s\"'`]+)", re.IGNORECASE | re.ASCII)

# Common passwords and common words of passwords, most frequent first.
WORDS = """password 123456 qwerty admin welcome login letmein monkey dragon master secret token root test
guest user default changeme hello iloveyou sunshine princess football baseball shadow superman batman
trustno michael jordan hunter ranger buster soccer hockey killer george andrew charlie thomas jessica
daniel access love money summer winter spring autumn monday friday january june july august october
december company server database system service account private public example sample demo temp
computer internet network office school house family mother father friend happy lucky star angel
flower cookie coffee chocolate banana apple orange cherry tiger lion eagle wolf bear horse dog cat
mustang ferrari porsche london paris berlin madrid america freedom forever nothing something the and
for you not with this that from your have are was one two three four five six seven eight nine zero
red blue green black white silver gold""".split() + PLAIN
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
LOOK_ALIKE = str.maketrans("@4310$57!", "aaeiossti")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)
YEARS, LETTER, OTHER = 120, log10(26), 1.0  # guesses of years and of brute-forced characters
UNSEEN, USUAL = 5.5, 1.5  # log10 of the words of a language; surprise a letter up to which a run is like them


class GuessCost:
    """log10 of the guesses a value takes; ``triples`` are counts of ``letters.corpus_triples``."""

    def __init__(self, words: Sequence[str] = WORDS, triples: Mapping[str, int] | None = None):
        self.rank = {w: r for r, w in reversed(list(enumerate(words, 1)))}
        self.lengths = sorted({len(w) for w in self.rank})
        self.near = {(a, b) for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)}
        self.near |= {(b, a) for a, b in self.near}
        listed = triples_of(w for w in self.rank if RUN.fullmatch(w))
        listed.update(triples or {})
        self.model = LetterModel(listed)

    @staticmethod
    def _cases(piece: str) -> float:
        upper = sum(c.isupper() for c in piece)
        if len(piece) > LONGEST:  # no word of a list: each capital doubles the guesses
            return upper * log10(2)
        half = min(upper, len(piece) - upper) if upper < len(piece) else 1
        return 0.0 if not upper else log10(max(2, sum(comb(len(piece), k) for k in range(1, max(1, half) + 1))))

    def _unseen(self, piece: str) -> float:
        return UNSEEN + max(0.0, self.model.surprise(piece.lower()) - USUAL * len(piece)) + self._cases(piece)

    def _words(self, value: str):
        """Spans of listed words and of runs of letters, by start."""
        lower = value.lower()
        if len(lower) != len(value):  # a letter whose lower case is longer: no positions to map back
            return
        plain = lower.translate(LOOK_ALIKE)
        runs = {m.start(): m.end() for m in RUN.finditer(lower)}
        for start in range(len(value)):
            if start in runs:
                yield start, runs[start], self._unseen(value[start:runs[start]])
            for length in self.lengths:
                end = start + length
                if end > len(value):
                    break
                rank, looks = self.rank.get(lower[start:end]), 0.0
                if rank is None:
                    rank, looks = self.rank.get(plain[start:end]), log10(4)
                if rank is not None:
                    yield start, end, log10(rank) + looks + self._cases(value[start:end])

    def _walks(self, value: str):
        lower, start = value.lower(), 0
        if len(lower) != len(value):
            return
        for at in range(1, len(lower) + 1):
            if at == len(lower) or (lower[at - 1], lower[at]) not in self.near:
                if at - start >= 4:
                    turns = sum(lower[i:i + 1] > lower[i + 1:i + 2] for i in range(start, at - 1))
                    yield start, at, log10(40) + log10(at - start) + min(turns, at - start - turns) * log10(2)
                start = at

    def _dates(self, value: str):
        for m in DATE.finditer(value):
            whole = m.end() - m.start() > 4
            yield m.start(), m.end(), log10(YEARS) + whole * log10(365) + bool(m[1] or m[2]) * log10(4)

    def cost(self, value: str, limit: float = inf, inner: bool = False) -> float:
        """The least cost, or some figure from ``limit`` on if it is not below ``limit``."""
        if not value:
            return 0.0
        starts: dict[int, list[tuple[int, float]]] = {}
        for start, end, cost in chain(self._walks(value), self._dates(value)):
            starts.setdefault(start, []).append((end, cost))
        if not inner:
            for m in REPEAT.finditer(value):
                cost = self.cost(m[1], inner=True) + log10((m.end() - m.start()) / len(m[1]))
                starts.setdefault(m.start(), []).append((m.end(), cost))
        words = self._words(value)
        word = next(words, None)
        least, last = {0: 0.0}, 0  # last: the last state reached below the limit
        for at in range(len(value)):
            if at > last:
                return limit
            here = least.pop(at, inf)
            steps = [(at + 1, LETTER if value[at].isalpha() else OTHER), *starts.pop(at, ())]
            while word is not None and word[0] == at:
                steps.append(word[1:])
                word = next(words, None)
            for end, cost in steps:
                if here + cost < min(limit, least.get(end, inf)):
                    least[end] = here + cost
                    last = max(last, end)
        return least.get(len(value), limit)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, scorer: GuessCost, least_cost: float, least_length: int) -> list[tuple[str, int, int]]:
    spans = []
    for m in CONTEXT.finditer(text):
        value = m[1].split("@")[0] if m[0].find("://") >= 0 else m[1]
        value = value.rstrip(".,;:!?)]}>")
        if len(value) >= least_length and scorer.cost(value, least_cost) >= least_cost:
            spans.append(("guess", m.start(1), m.start(1) + len(value)))
    return spans


def all_spans(text: str, scorer: GuessCost, least_cost: float, least_length: int) -> list[tuple[str, int, int]]:
    found = base_spans(text) + guess_spans(text, scorer, least_cost, least_length)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def learnt_triples(docs: DataFrame) -> dict[str, int]:
    """The letter triples of the words of all texts outside credential values; of bounded size."""
    return corpus_triples(docs, f"(?i){CONTEXT.pattern}")


def secret_spans(text: Column, words: Sequence[str] = WORDS, triples: Mapping[str, int] | None = None,
                 least_cost: float = 8.0, least_length: int = 8) -> Column:
    """Spans of a text by start, then kind; code points, end exclusive.

    ``least_cost`` is log10 of the guesses from which a value counts as a secret.
    """
    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = GuessCost(words, triples)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e}
                              for k, s, e in all_spans(t, scorer, least_cost, least_length)] for t in texts])

    return scan(F.coalesce(text, F.lit("")))


def masked_text(text: Column, mask: str = "[SECRET]", words: Sequence[str] = WORDS,
                triples: Mapping[str, int] | None = None, least_cost: float = 8.0, least_length: int = 8) -> Column:
    """The text with every span, overlapping ones joined, replaced by ``mask``; null stays null."""
    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = GuessCost(words, triples)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            parts, at, end = [], 0, 0
            for _, s, e in all_spans(t, scorer, least_cost, least_length):
                if s >= end:
                    parts += [t[at:s], mask]
                    at = e
                at = end = max(end, e)
            return "".join(parts) + t[at:]

        for texts in batches:
            yield pd.Series([one(t) for t in texts])

    return hide(text)
