"""Grounding audit: numbers, names and contradictions of drafts against tiered evidence.

``drafts`` has draft_id and text; ``evidence`` has draft_id, source_ord (position of the source in
the draft's list, counted from 1), tier and text. Text work is done where the rows are; only
figures, names and flags are shuffled, apart from one pass that brings evidence to its draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions import prose
from auditloom.functions.text import text
from auditloom.operators.registers import gathered


def sentence_table(drafts: DataFrame) -> DataFrame:
    """(draft_id, sent_no, sentence, names, figures), one row per sentence, no shuffle."""
    rows = drafts.select("draft_id", F.posexplode(prose.sentences(F.col("text")))
                         .alias("sent_no", "sentence"))
    return rows.select("draft_id", "sent_no", "sentence",
                       prose.entities(F.col("sentence")).alias("names"),
                       prose.numbers(F.col("sentence")).alias("figures"))


def with_reasons(sentences: DataFrame) -> DataFrame:
    """Add why a sentence needs a second look, for tables that are landed and read by several sections."""
    return sentences.withColumn("reasons", prose.triage_reasons(F.col("sentence"), F.col("names"), F.col("figures")))


def triaged(sentences: DataFrame) -> DataFrame:
    """The sentences worth a second look, with their reasons."""
    return (sentences if "reasons" in sentences.columns else with_reasons(sentences)).filter(F.size("reasons") > 0)


def number_grounding(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, num, best_tier): every checked figure of a draft and its best source's tier.

    ``best_tier`` is null where no source carries the figure. Evidence is reduced to the minimum
    tier per (draft, figure) before it is shuffled.
    """
    wanted = drafts.select("draft_id", F.explode(prose.numbers(F.col("text"))).alias("num")).filter(
        F.length("num") >= 2)
    offered = (evidence.select("draft_id", "tier", F.explode(prose.numbers(F.col("text")))
                               .alias("num")).filter(F.length("num") >= 2)
               .groupBy("draft_id", "num").agg(F.min("tier").alias("best_tier")))
    return wanted.join(offered, ["draft_id", "num"], "left")


def ungrounded_numbers(grounding: DataFrame) -> DataFrame:
    return grounding.filter("best_tier IS NULL").select("draft_id", "num")


def low_trust_numbers(grounding: DataFrame) -> DataFrame:
    return grounding.filter(F.col("best_tier") >= fixed.LOW_TRUST_TIER)


def contradictions(sentences: DataFrame) -> DataFrame:
    """(draft_id, entity, nums): names that stand beside two or more different figures.

    Name and figure pairs are made distinct where they are and again by pair, so a name in very many
    sentences is spread over its figures and only its different figures are ever listed. They are
    listed from sorted rows, in one pass.
    """
    named = sentences.filter(F.size("figures") > 0).select(
        "draft_id", F.explode(F.array_distinct("names")).alias("entity"), "figures")
    pairs = named.select("draft_id", "entity", F.explode(F.array_distinct("figures")).alias("num")).distinct()
    return gathered(pairs, "draft_id", "entity").agg(
        F.sort_array(F.collect_list("num")).alias("nums")).filter(F.size("nums") > 1)


def folded_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select("draft_id", "source_ord", F.lower(text(F.col("text"))).alias("low"))


def checked_names(sentences: DataFrame) -> DataFrame:
    """(draft_id, entity): the names of triaged sentences."""
    return triaged(sentences).select("draft_id", F.explode(F.array_distinct("names"))
                                     .alias("entity")).distinct()


def wanted_names(names: DataFrame) -> DataFrame:
    """(draft_id, kind, key): what to look for; names that fold alike are made one where they are listed."""
    return names.select("draft_id", F.lit("name").alias("kind"), F.lower("entity").alias("key"))


def unmet_names(names: DataFrame, hits: DataFrame) -> DataFrame:
    """(draft_id, entity): names that no source of the draft contains, given the hits."""
    met = hits.filter("kind = 'name'").select("draft_id", F.col("key").alias("folded")).distinct()
    return names.withColumn("folded", F.lower("entity")).join(
        met, ["draft_id", "folded"], "left_anti").select("draft_id", "entity")


def by_length(numbers: Column) -> Column:
    """Report order of figures: longest first, then by text."""
    return F.sort_array(F.transform(numbers, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))["n"]
