"""The diff report: one row per decision with every run's choice, and its Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import strip, text
from auditloom.operators.diff import decision_diff
from auditloom.operators.registers import last_rows
from auditloom.sources.registers import list_runs, read_decision_runs


def _or_else(value: Column, other: str) -> Column:
    return F.coalesce(value, F.lit(other))


def diff_report(decisions: DataFrame) -> DataFrame:
    """(decision_id, status, choices, markdown) over all runs of ``decisions``.

    ``choices`` holds one entry per compared run in run order, absent runs included; it is bounded
    by the number of runs, which is the width of the comparison.
    """
    runs = decisions.groupBy().agg(F.array_sort(F.collect_set("run_id")).alias("run_ids"))
    rows = decisions.withColumn("did", F.upper(strip(F.col("decision_id")))).filter("did <> ''")
    latest = last_rows(rows, ["run_id", "did"])
    said = latest.groupBy("did").agg(F.map_from_entries(F.collect_list(F.struct(
        "run_id", F.struct("decided_by", "chosen", "alternatives", "rationale")))).alias("said"))
    labelled = decision_diff(decisions).join(said.withColumnRenamed("did", "decision_id"),
                                             "decision_id").withColumn("run_ids", runs.scalar())

    def choice(run: Column) -> Column:
        row = F.try_element_at("said", run)
        return F.struct(run.alias("run"), _or_else(row["decided_by"], "unspecified").alias("by"),
                        _or_else(row["chosen"], "[empty]").alias("chosen"),
                        text(row["alternatives"]).alias("alternatives"),
                        text(row["rationale"]).alias("rationale"))

    def lines(c: Column) -> Column:
        optional = [F.when(c[k] != "", F.concat(F.lit(f"  - *{k.title()}:* "), c[k]))
                    for k in ("alternatives", "rationale")]
        return F.concat_ws("\n", F.concat(F.lit("- **"), c["run"], F.lit("** (`"), c["by"],
                                          F.lit("`):")),
                           F.concat(F.lit("  - *Chosen:* "), c["chosen"]), *optional)

    report = labelled.withColumn("choices", F.transform("run_ids", choice))
    head = F.concat(F.lit("## "), "decision_id", F.lit(" ("), "stage", F.lit(": "), "question",
                    F.lit(")\n**Status:** "), "status", F.lit("\n"))
    return report.select("decision_id", "stage", "question", "status", "first_seen", "choices",
                         F.concat_ws("\n", head, F.array_join(F.transform("choices", lines), "\n"))
                         .alias("markdown")).orderBy("first_seen")


def diff_lines(decisions: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The report as one row per decision and compared run, absent runs included.

    ``runs`` is the list (run_id, run_ord) in the order of comparison, by default the runs of
    ``decisions`` by name: of those only the ids are gathered. Every row holds the text of one run,
    so no row grows with their number; the rows are what the report prints.
    """
    if runs is None:
        runs = decisions.select("run_id").distinct().withColumn("run_ord", F.col("run_id"))
    rows = decisions.withColumn("did", F.upper(strip(F.col("decision_id")))).filter("did <> ''")
    said = last_rows(rows, ["run_id", "did"]).select(
        "run_id", F.col("did").alias("decision_id"), F.lit(True).alias("here"), "decided_by", "chosen",
        "alternatives", "rationale")
    labelled = decision_diff(decisions, runs=runs).select("decision_id", "stage", "question", "status", "first_seen")
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("run_ord", "run_id")))).scalar()
    lines = labelled.withColumn("run", listed).withColumn("run", F.explode("run")).select(
        *labelled.columns, "run.run_ord", "run.run_id")
    told = lines.join(said, ["run_id", "decision_id"], "left")
    return told.select("decision_id", "stage", "question", "status", "first_seen", "run_ord", "run_id",
                       _or_else(F.col("decided_by"), "unspecified").alias("decided_by"),
                       F.when(F.col("here"), text(F.col("chosen"))).otherwise("[empty]").alias("chosen"),
                       text(F.col("alternatives")).alias("alternatives"),
                       text(F.col("rationale")).alias("rationale"))


def diff_folders(spark: SparkSession, root: str, files: str = "decisions.csv") -> DataFrame:
    """The report, line by line, over one folder per run below ``root``; empty registers count."""
    runs = list_runs(spark, root, files)
    return diff_lines(read_decision_runs(spark, root, files), runs).orderBy("first_seen", "run_ord")
