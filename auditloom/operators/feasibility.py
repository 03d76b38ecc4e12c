"""Feasibility registers: permitted questions and results, attribution, dates and custody."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.actors import actor_identity
from auditloom.functions.prose import bare_numbers
from auditloom.functions.routes import held_path, usable_url
from auditloom.functions.text import blank, iso_date, strip, unusable
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import repeats, stage_order, with_columns

ARM = "FEASIBILITY"


def prepared(probes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    raw = strip(F.col("probe_id"))
    rows = with_columns(probes, fixed.PROBE_COLUMNS).withColumns({
        "pid": F.when(raw != "", raw).otherwise(F.concat(F.lit("row "), "row_no")),
        "asked": strip(F.col("question")), "answer": strip(F.col("result"))})
    if held is None:
        return rows.withColumn("file_sha256", F.lit(None).cast("string"))
    files = held.select(F.col("project_id").alias("_p"), "rel_path", "file_sha256")
    return rows.join(files, (F.col("project_id") == F.col("_p"))
                     & (held_path(F.col("local_path")) == F.col("rel_path")), "left"
                     ).drop("_p", "rel_path")


def _rules() -> list[Rule]:
    asked, answer = F.col("asked"), F.col("answer")
    permitted = answer.isin(fixed.PROBE_RESULTS)
    no_date, on = blank(F.col("access_date")), iso_date(F.col("access_date"))
    custody = (asked == "bytes_retrievable") & (answer == "available")
    no_path = custody & blank(F.col("local_path"))
    held = custody & ~no_path & F.col("file_sha256").isNotNull()
    unhashed = held & blank(F.col("sha256"))
    period = asked == "period_and_retention"
    derives = F.lower(strip(F.col("derives_from_subject")))
    covers = F.lower(strip(F.col("covers_population")))
    return [
        Rule("id_unusable", unusable(F.col("probe_id")), F.col("probe_id")),
        Rule("source_name_empty", unusable(F.col("source_name"))),
        Rule("actor_not_comparable", actor_identity(F.col("probed_by")).isNull(),
             F.col("probed_by")),
        Rule("question_not_permitted", ~asked.isin(fixed.PROBE_QUESTIONS), asked),
        Rule("result_not_permitted", ~permitted, answer),
        Rule("result_without_reason", permitted & (answer != "available")
             & unusable(F.col("notes")), answer),
        Rule("date_missing", no_date),
        Rule("date_not_iso", ~no_date & on.isNull(), F.col("access_date")),
        Rule("date_after_scope", ~no_date & (on > F.col("latest_scope")), on),
        Rule("retrievable_without_path", no_path),
        Rule("path_not_held", custody & ~no_path & F.col("file_sha256").isNull(),
             strip(F.col("local_path"))),
        Rule("held_not_hashed", unhashed, F.col("file_sha256")),
        Rule("hash_mismatch", held & ~unhashed & (strip(F.col("sha256")) != F.col("file_sha256")),
             F.col("file_sha256")),
        Rule("period_empty", period & unusable(F.col("stated_period"))),
        Rule("retention_empty", period & unusable(F.col("retention_policy"))),
        Rule("derivation_unanswered", (asked == "derivation_independence")
             & ~derives.isin(fixed.TERNARY), derives),
        Rule("coverage_unanswered", (asked == "population_coverage")
             & ~covers.isin(fixed.TERNARY), covers),
        Rule("locator_missing", unusable(F.col("evidence_locator")) & ~usable_url(F.col("url"))),
    ]


def probe_row_findings(rows: DataFrame, scope_dates: DataFrame | None = None) -> DataFrame:
    if scope_dates is None:
        rows = rows.withColumn("latest_scope", F.lit(None).cast("date"))
    else:
        rows = rows.join(scope_dates.select("project_id", "latest_scope"), "project_id", "left")
    # a later row repeats an id only when it has a usable one; any earlier row counts
    again = repeats(rows, ["project_id", "pid"]).filter(~unusable(F.col("probe_id")))
    return union_all([
        apply_rules(rows, ARM, _rules(), F.col("pid"), F.col("row_no")),
        apply_rules(again, ARM, [Rule("recorded_twice", F.lit(True))], F.col("pid"),
                    F.col("row_no")),
    ])


def probe_coverage(rows: DataFrame) -> DataFrame:
    """Per project: probes, permitted questions answered, those missing, and whether all unknown."""
    asked = F.when(F.col("asked").isin(fixed.PROBE_QUESTIONS), F.col("asked"))
    every = F.array(*[F.lit(q) for q in sorted(fixed.PROBE_QUESTIONS)])
    return rows.groupBy("project_id").agg(
        F.count("*").alias("probes"), F.max("through_ord").alias("through_ord"),
        F.collect_set(asked).alias("answered"),  # at most the five permitted questions
        F.min(F.col("answer") == "unknown").alias("all_unknown"),
    ).select("project_id", "through_ord", "probes", F.size("answered").alias("questions"),
             F.array_join(F.array_except(every, F.col("answered")), ", ").alias("missing"),
             "all_unknown")


def note_numbers(rows: DataFrame) -> DataFrame:
    """Figures in probe notes, in register order: project_id, pid, row_no, place, token."""
    return rows.select("project_id", "pid", "row_no",
                       F.posexplode(bare_numbers(F.col("notes"))).alias("place", "token"))


def note_number_preview(rows: DataFrame) -> DataFrame:
    """Per project: how many figures the notes carry, and the first eight of them.

    The first eight are kept by a bounded rank, reduced before the shuffle, not by collecting all.
    """
    from pyspark.sql import Window

    tokens = note_numbers(rows)
    counts = tokens.groupBy("project_id").agg(F.count("*").alias("tokens"))
    order = Window.partitionBy("project_id").orderBy("row_no", "place")
    top = (tokens.withColumn("rank", F.row_number().over(order))
           .filter(F.col("rank") <= fixed.PREVIEW_TOKENS)
           .groupBy("project_id")
           .agg(F.array_sort(F.collect_list(F.struct(
               "rank", F.concat("pid", F.lit(":"), "token").alias("shown")))).alias("top")))
    more = F.when(F.col("tokens") > fixed.PREVIEW_TOKENS, " ...").otherwise("")
    return counts.join(top, "project_id").select("project_id", "tokens", F.concat(
        F.array_join(F.transform("top", lambda t: t["shown"]), ", "), more).alias("preview"))


def feasibility_findings(projects: DataFrame, probes: DataFrame, held: DataFrame | None = None,
                         scope_dates: DataFrame | None = None) -> DataFrame:
    """All probe rules for the v0.3 ``projects`` (project_id, contract, through_ord)."""
    rows = prepared(probes, held)
    coverage = probe_coverage(rows)
    at_data = F.col("through_ord") >= stage_order("data")
    empty = projects.filter(F.col("contract") == "v0.3").join(
        rows.select("project_id").distinct(), "project_id", "left_anti")
    note = F.format_string("probes=%d questions=%d", "probes", "questions")
    return union_all([
        probe_row_findings(rows, scope_dates),
        apply_rules(empty, ARM, [Rule("no_probes", at_data)]),
        apply_rules(coverage, ARM, [
            Rule("question_not_probed", at_data & (F.col("missing") != ""), F.col("missing")),
            Rule("coverage", F.lit(True), note, "note"),
            Rule("all_unknown", F.col("all_unknown"), F.col("probes"), "note"),
        ]),
        apply_rules(note_number_preview(rows), ARM, [Rule(
            "numbers_in_notes", F.lit(True), F.format_string("%d: %s", "tokens", "preview"),
            "note")]),
    ])
