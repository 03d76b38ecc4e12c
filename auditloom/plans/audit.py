"""The grounding audit of many drafts at once: six sections and a verdict per draft."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators import attribution, grounding
from auditloom.operators.findings import union_all
from auditloom.operators.registers import gathered
from auditloom.session import written


class Sections(NamedTuple):
    ungrounded: DataFrame
    missing: DataFrame
    contradictions: DataFrame
    low_trust: DataFrame
    attributions: DataFrame
    triage: DataFrame


def audit_sections(drafts: DataFrame, evidence: DataFrame) -> Sections:
    """The six sections. Sentences, numbers, subjects and what evidence contains are landed, since
    several sections read each; evidence texts are searched for names and subjects in one pass. What
    stands beside a source is worked out only where an occurrence leaves its source.
    """
    sentences, _ = written(grounding.with_reasons(grounding.sentence_table(drafts)))
    numbers, _ = written(grounding.number_grounding(drafts, evidence))
    names, (subjects, _) = grounding.checked_names(sentences), written(attribution.first_attributions(sentences))
    wanted = grounding.wanted_names(names).unionByName(attribution.wanted_subjects(subjects))
    hits, seen = written(attribution.evidence_hits(wanted, evidence), F.count_if(F.size("edges") > 0).alias("open"))
    return Sections(
        grounding.ungrounded_numbers(numbers),
        grounding.unmet_names(names, hits),
        grounding.contradictions(sentences),
        grounding.low_trust_numbers(numbers),
        attribution.bound(subjects, hits, evidence, open_ends=seen["open"] > 0),
        grounding.triaged(sentences))


def missing_entities(sentences: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, entity): names of triaged sentences that no source of the draft contains."""
    names = grounding.checked_names(sentences)
    return grounding.unmet_names(names, attribution.evidence_hits(grounding.wanted_names(names), evidence))


def hard_flags(sections: Sections) -> DataFrame:
    """(draft_id, section, item, value): every flag that counts against a draft."""
    def flags(rows: DataFrame, section: str, item: str, value) -> DataFrame:
        return rows.select("draft_id", F.lit(section).alias("section"), F.col(item).alias("item"),
                           value.cast("string").alias("value"))

    none = F.lit("")
    bad = sections.attributions.filter(F.col("status") != "PRESENT")
    return (flags(sections.ungrounded, "number_missing", "num", none)
            .unionByName(flags(sections.missing, "entity_missing", "entity", none))
            .unionByName(flags(sections.contradictions, "contradiction", "entity",
                               F.array_join("nums", ", ")))
            .unionByName(flags(sections.low_trust, "low_trust_number", "num", F.col("best_tier")))
            .unionByName(flags(bad, "attribution", "subject", F.col("status"))))


def audit_verdict(drafts: DataFrame, flags: DataFrame) -> DataFrame:
    """(draft_id, hard_flags, clean) for every draft id, flagged or not; drafts count as no flag."""
    tagged = drafts.select("draft_id", F.lit(0).alias("flag")).unionByName(
        flags.select("draft_id", F.lit(1).alias("flag")))
    total = F.sum("flag")
    return tagged.groupBy("draft_id").agg(total.alias("hard_flags"), (total == 0).alias("clean"))


DRAFT, NUMBER, ENTITY, CONTRADICTION, LOW_TRUST, ATTRIBUTION, TRIAGE = range(7)


def _tagged(rows: DataFrame, section: int, text: str | None = None, more: str | None = None,
            number: str | None = None, listed: str | None = None) -> DataFrame:
    """The rows of one section in the form all sections share."""
    def named(column, kind, name):
        return (F.lit(None) if column is None else F.col(column)).cast(kind).alias(name)

    return rows.select("draft_id", F.lit(section).alias("section"), named(text, "string", "text"),
                       named(more, "string", "more"), named(number, "int", "number"),
                       named(listed, "array<string>", "listed"))


def audit_report(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per draft id: the six sections as arrays in report order, and the verdict.

    A section's array is bounded by the draft's own text, whatever the number of its sources. The
    sections and the drafts are one tagged table, moved and sorted by draft once.
    """
    s = audit_sections(drafts, evidence)
    preview = s.triage.withColumn("preview", F.substring("sentence", 1, fixed.PREVIEW_SENTENCE_CHARS))
    rows = union_all([
        _tagged(drafts, DRAFT),
        _tagged(s.ungrounded, NUMBER, "num"),
        _tagged(s.missing, ENTITY, "entity"),
        _tagged(s.contradictions, CONTRADICTION, "entity", listed="nums"),
        _tagged(s.low_trust, LOW_TRUST, "num", number="best_tier"),
        _tagged(s.attributions.withColumn("keys", F.array(F.col("key").cast("string"))), ATTRIBUTION, "subject", "status",
                listed="keys"),
        _tagged(preview, TRIAGE, "preview", number="sent_no", listed="reasons")])

    def of(section: int, *item):
        return F.collect_list(F.when(F.col("section") == section, F.struct(*item) if len(item) > 1 else item[0]))

    text, number, listed = F.col("text"), F.col("number"), F.col("listed")
    report = gathered(rows, "draft_id").agg(
        grounding.by_length(of(NUMBER, text)).alias("numbers_missing"),
        F.sort_array(of(ENTITY, text)).alias("entities_missing"),
        F.sort_array(of(CONTRADICTION, text.alias("entity"), listed.alias("nums"))).alias("contradictions"),
        F.sort_array(of(LOW_TRUST, (-F.length("text")).alias("k"), text.alias("num"),
                        number.alias("best_tier"))).alias("low_trust"),
        F.sort_array(of(ATTRIBUTION, F.get("listed", F.lit(0)).alias("key"), text.alias("subject"),
                        F.col("more").alias("status"))).alias("attributions"),
        F.sort_array(of(TRIAGE, number.alias("sent_no"), text.alias("sentence"),
                        listed.alias("reasons"))).alias("triage"))
    hard = F.filter("attributions", lambda a: a["status"] != "PRESENT")
    total = (F.size("numbers_missing") + F.size("entities_missing") + F.size("contradictions")
             + F.size("low_trust") + F.size(hard))
    return report.withColumns({"hard_flags": total, "clean": total == 0})
