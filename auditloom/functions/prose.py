"""Sentences, names, numbers and attributions of a running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import strip, text


def _all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def numbers(value: Column) -> Column:
    """Distinct figures as strings: digests removed, grouping commas dropped."""
    body = text(value)
    clean = F.when(body.rlike("[0-9a-fA-F]{40}"),
                   F.regexp_replace(body, fixed.HEX_DIGEST, " ")).otherwise(body)
    return F.array_distinct(
        F.transform(_all(clean, fixed.NUMBER), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def sentences(value: Column) -> Column:
    """Non-empty sentences in order; a line break counts as a space.

    Blanks are taken off the ends of the whole text. A break takes all blanks behind its mark, so no
    sentence begins or ends with one, and only a text without any character leaves an empty part.
    """
    whole = strip(F.replace(text(value), F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(whole, fixed.SENTENCE_BREAK), "")


def entities(sentence: Column) -> Column:
    """Capitalised spans of one to four words, repeats kept, a lone opening word left out.

    The place of the first span is looked for only where the sentence begins with that span's words.
    """
    found = _all(sentence, fixed.ENTITY, 1)
    first = F.get(found, F.lit(0))
    lone_opening = (F.startswith(sentence, first) & ~F.contains(first, F.lit(" "))
                    & (F.regexp_instr(sentence, F.lit(fixed.ENTITY)) == 1))
    return F.when(lone_opening, F.slice(found, F.lit(2), F.size(found))).otherwise(found)


def cited(sentence: Column) -> Column:
    return (sentence.rlike(fixed.CITED_URL) | sentence.rlike(fixed.CITED_BRACKET)
            | sentence.rlike(fixed.CITED_PARENTHESIS))


def hedged(sentence: Column) -> Column:
    return sentence.rlike(fixed.HEDGE)


def dated(sentence: Column) -> Column:
    return sentence.rlike(fixed.DATE_IN_SENTENCE)


def triage_reasons(sentence: Column, names: Column, figures: Column) -> Column:
    """Why a sentence needs a second look; an empty array when it does not.

    At most one of two reasons stands behind the density, so there are six lists, and one is picked.
    """
    has_figures = F.size(figures) > 0
    dense = (F.size(names) > 1) | has_figures
    second = F.when(dense & hedged(sentence), 1).when(dense & ~cited(sentence), 2).otherwise(0)
    density = F.when((F.size(names) > 2) | has_figures | dated(sentence), 3).otherwise(0)
    lists = [first + then for first in ([], ["density"]) for then in ([], ["hedged"], ["uncited"])]
    return F.get(F.array(*[F.array(*map(F.lit, one)).cast("array<string>") for one in lists]), density + second)


def attribution_spans(sentence: Column) -> Column:
    """array<array<string>>: the who-said, according-to and whose-report spans, as they stand."""
    return F.array(*[F.when(F.contains(sentence, F.lit(held)), _all(sentence, pattern, 1))
                     for pattern, held in zip(fixed.ATTRIBUTIONS, fixed.ATTRIBUTION_HOLDS, strict=True)])


def bare_numbers(value: Column) -> Column:
    """Free-standing figures of a note with at least two characters, repeats kept."""
    return F.filter(_all(text(value), fixed.BARE_NUMBER),
                    lambda n: F.length(F.replace(n, F.lit(","), F.lit(""))) >= 2)


def prose_numbers(value: Column) -> Column:
    """Distinct figures of more than two characters outside code spans and addresses."""
    clean = F.regexp_replace(text(value), fixed.PROSE_NOISE, " ")
    return F.array_distinct(F.filter(_all(clean, fixed.PROSE_NUMBER), lambda n: F.length(n) > 2))


def digit_runs(value: Column) -> Column:
    """Distinct maximal runs of digits, commas and dots: any prose number lies inside one."""
    return F.array_distinct(_all(text(value), rf"[{fixed.DIGIT},.]+"))
