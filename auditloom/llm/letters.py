"""How natural a run of letters is: a model of letter triples over the distinct words of a corpus.

The counts have one entry per triple of 58 letters and two word ends, at most 60 ** 3 rows however large the
corpus, and every distinct word of every text is counted. They are what the driver holds and tasks receive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import cached_property
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "a-zß-öø-ÿ"
RUN = re.compile(f"[{LETTERS}]{{4,}}")
LONGEST = 24  # longer runs are no words: they teach nothing, but are scored like all others


def triples_of(words: Iterable[str]) -> Counter:
    return Counter(f"^^{w}$"[i:i + 3] for w in set(words) for i in range(len(w) + 1))


def corpus_triples(docs: DataFrame, without: str) -> dict[str, int]:
    """Triples of the distinct lower-cased words that stand in two rows or more, pieces that match ``without`` left out.

    Null texts have no words; a word counts once however often it stands in the corpus, so copies and hot
    words weigh nothing. Words are made distinct within each text and within tasks before they are shuffled.
    """
    plain = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), without, " "))
    each = docs.select(F.explode(F.array_distinct(F.split(plain, r"[^\p{L}\p{N}]+"))).alias("word"))
    kept = (each.where(F.col("word").rlike(f"^[{LETTERS}]{{3,{LONGEST}}}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").select(F.concat(F.lit("^^"), "word", F.lit("$")).alias("w")))
    places = F.sequence(F.lit(1), F.char_length("w") - 2)
    triples = kept.select(F.explode(F.transform(places, lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("t"))
    return {r.t: r.n for r in triples.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


class LetterModel:
    """P(letter | two before), each order smoothed by the next lower one in the manner of Witten and Bell."""

    def __init__(self, triples: Mapping[str, int]):
        self.triples = triples

    @cached_property
    def tables(self):
        """Counts of continuations, their sums and their kinds for contexts of two, one and no letters."""
        own, total, kinds = [Counter() for _ in range(3)], [Counter() for _ in range(3)], [Counter() for _ in range(3)]
        for t, n in self.triples.items():
            for order in range(3):
                piece = t[2 - order:]
                kinds[order][piece[:-1]] += piece not in own[order]
                own[order][piece] += n
                total[order][piece[:-1]] += n
        return own, total, kinds

    def chance(self, triple: str) -> float:
        own, total, kinds = self.tables
        p = 1 / 60
        for order in range(3):
            piece = triple[2 - order:]
            seen = total[order][piece[:-1]]
            if seen:
                many = kinds[order][piece[:-1]]
                p = (own[order][piece] + many * p) / (seen + many)
        return p

    def surprise(self, word: str) -> float:
        """-log10 of the chance of a word, its end included."""
        padded = f"^^{word}$"
        return -sum(log10(self.chance(padded[i:i + 3])) for i in range(len(word) + 1))
