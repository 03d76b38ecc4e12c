"""Draft sections, and draft figures that appear nowhere in a project's claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.digests import any_match
from auditloom.functions.prose import digit_runs, prose_numbers
from auditloom.functions.text import let, text
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import stage_order
from auditloom.session import written

ARM = "DRAFT"
PART = 4096  # characters of a run cut into pieces at once
SHORT = 64  # characters of a run whose pieces are cut by position


def section_flags(drafts: DataFrame) -> DataFrame:
    """Six booleans per draft: four sections it must carry and two readings worth a note."""
    body, low = text(F.col("text")), F.lower(text(F.col("text")))
    return drafts.withColumns({
        "has_falsifier": low.rlike(fixed.DRAFT_FALSIFIER),
        "has_verification": any_match(body, fixed.DRAFT_VERIFICATION),
        "has_coi": any_match(low, fixed.DRAFT_COI),
        "has_negative_results": any_match(body, fixed.DRAFT_NEGATIVE),
        "names_baseline": low.rlike(fixed.DRAFT_BASELINE),
        "exit_without_censoring": low.rlike(fixed.DRAFT_EXIT) & ~low.rlike(fixed.DRAFT_CENSORING),
    })


def _pieces(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(project_id, token): all pieces of the runs that have a wanted length.

    Nearly all runs are short and are cut by position. In a long one a look-ahead yields the pieces of
    one length in a single walk; it is cut first, each part with the beginning of the next, so no row
    holds more than a part's pieces. Patterns differ by length, so each would be compiled anew.
    """
    rows = runs.join(sizes, "project_id").filter(F.length("run") >= F.col("size"))
    width = F.greatest(F.col("size"), F.lit(PART))
    parts = F.regexp_extract_all("run", F.format_string("(?s).{1,%d}", width), F.lit(0))
    joined = let(parts, lambda ps: F.transform(ps, lambda part, i: F.concat(
        part, F.left(F.coalesce(F.get(ps, i + 1), F.lit("")), F.col("size") - 1))))
    cut = rows.select("project_id", "size", F.when(F.length("run") <= SHORT, F.array("run")).otherwise(joined).alias("parts"))
    each = cut.select("project_id", "size", F.explode("parts").alias("part")).filter(F.length("part") >= F.col("size"))
    places = F.sequence(F.lit(1), F.length("part") - F.col("size") + 1)
    found = (F.when(F.length("part") == F.col("size"), F.array("part"))
             .when(F.length("part") <= SHORT, F.transform(places, lambda at: F.substring("part", at, F.col("size"))))
             .otherwise(F.regexp_extract_all("part", F.format_string("(?s)(?=(.{%d}))", "size"), F.lit(1))))
    listed = each.select("project_id", found.alias("found"))
    return listed.select("project_id", F.explode("found").alias("token")).distinct()


def loose_numbers(drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """(project_id, name, token): draft figures contained in no claim text or uncertainty.

    A figure can only sit inside a run of digits, commas and dots. Claims are reduced to their
    distinct runs, and the figures of a project have few different lengths: runs yield their pieces
    of just these lengths, and figures meet equal pieces. The work is linear in the runs times the
    lengths, however many figures begin alike. Figures are landed, since drafts would be read twice.
    They have more than two characters, so runs of fewer hold none.
    """
    tokens, _ = written(drafts.select("project_id", "name", F.explode(prose_numbers(F.col("text")))
                                      .alias("token")))
    said = F.concat_ws(" ", text(F.col("claim_text")), text(F.col("uncertainty")))
    runs = claims.select("project_id", F.explode(digit_runs(said)).alias("run")).filter(F.length("run") > 2).distinct()
    sizes = tokens.select("project_id", F.length("token").alias("size")).distinct()
    return tokens.join(_pieces(runs, sizes), ["project_id", "token"], "left_anti")


def loose_preview(loose: DataFrame) -> DataFrame:
    """Per draft: how many figures are loose, and the first eight in text order.

    Figures are ranked once: the last rank is their number, and only the first ones are listed, so a
    draft's list never holds more than it shows.
    """
    draft = ["project_id", "name"]
    place = Window.partitionBy(*draft).orderBy("token")
    ranked = loose.filter("project_id IS NOT NULL AND name IS NOT NULL").withColumn("place", F.row_number().over(place))
    shown = F.collect_list(F.when(F.col("place") <= fixed.PREVIEW_TOKENS, F.col("token")))
    listed = ranked.groupBy(*draft).agg(F.max("place").cast("bigint").alias("tokens"),
                                        F.array_join(F.array_sort(shown), ", ").alias("shown"))
    more = F.when(F.col("tokens") > fixed.PREVIEW_TOKENS, " ...").otherwise("")
    return listed.select(*draft, "tokens", F.concat("shown", more).alias("preview"))


def draft_findings(projects: DataFrame, drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """Draft rules for the ``projects`` at stage 'draft' or later."""
    due = projects.filter(F.col("through_ord") >= stage_order("draft")).select("project_id")
    rows = drafts.join(due, "project_id", "left_semi")
    none = due.join(rows.select("project_id").distinct(), "project_id", "left_anti")
    preview = loose_preview(loose_numbers(rows, claims))
    return union_all([
        apply_rules(none, ARM, [Rule("no_draft", F.lit(True))]),
        apply_rules(section_flags(rows), ARM, [
            Rule("no_falsifier", ~F.col("has_falsifier")),
            Rule("no_verification", ~F.col("has_verification")),
            Rule("no_conflict_note", ~F.col("has_coi")),
            Rule("no_negative_results", ~F.col("has_negative_results")),
            Rule("no_baseline", ~F.col("names_baseline"), severity="note"),
            Rule("exit_without_censoring", F.col("exit_without_censoring"), severity="note"),
        ], F.col("name")),
        apply_rules(preview, ARM, [Rule("loose_numbers", F.lit(True), F.format_string(
            "%d: %s", "tokens", "preview"), "note")], F.col("name")),
    ])
