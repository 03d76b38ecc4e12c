"""The common findings table: one row per error or note, and the verdict over it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ("project_id string, arm string, rule string, severity string, subject_id string, "
          "row_no bigint, detail string")
COLUMNS = ["project_id", "arm", "rule", "severity", "subject_id", "row_no", "detail"]


class Rule(NamedTuple):
    """A rule fires where ``when`` is true; ``detail`` carries the offending value."""

    name: str
    when: Column
    detail: Column | None = None
    severity: str = "error"


def _fired(rule: Rule) -> Column:
    detail = F.lit(None) if rule.detail is None else rule.detail
    return F.when(F.coalesce(rule.when, F.lit(False)), F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"),
        detail.cast("string").alias("detail")))


def apply_rules(rows: DataFrame, arm: str, rules: list[Rule], subject: Column | None = None,
                row_no: Column | None = None, more: Column | None = None) -> DataFrame:
    """Test every rule on every row in one pass and keep one output row per rule that fired.

    ``more`` may add an array<struct<rule, severity, detail>> for rules that fire several times. Rules
    that did not fire leave null in the array and are dropped after the explode: a filter over the array
    would have every rule interpreted, and what rules share worked out again for each. An outer explode
    has no filter put in front of it, for which all rules would be tested once more.
    """
    fired = F.array(*[_fired(rule) for rule in rules])
    if more is not None:
        fired = F.concat(fired, more)
    tested = rows.select(
        "project_id", F.lit(arm).alias("arm"),
        (F.lit("") if subject is None else subject).alias("subject_id"),
        (F.lit(None) if row_no is None else row_no).cast("bigint").alias("row_no"), fired.alias("fired"))
    found = tested.select("project_id", "arm", "subject_id", "row_no", F.explode_outer("fired").alias("f")).filter("f IS NOT NULL")
    return found.select("project_id", "arm", "f.rule", "f.severity", "subject_id", "row_no", "f.detail")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def verdict(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: number of errors and notes, and whether it passes (no error).

    Where the projects are those of the findings themselves, they are told from the counts: a join
    would have all findings worked out twice. A project without an id meets no finding either way.
    """
    counts = findings.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "note").alias("notes"))
    if projects is findings:
        known = F.col("project_id").isNotNull()
        met = counts.withColumns({n: F.when(known, F.col(n)).otherwise(0) for n in ("errors", "notes")})
        return met.withColumn("passed", F.col("errors") == 0)
    return projects.select("project_id").distinct().join(counts, "project_id", "left").select(
        "project_id", F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("notes", F.lit(0)).alias("notes"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Land findings as Parquet, one folder per arm so a reader can prune to the arms it needs."""
    findings.write.partitionBy("arm").parquet(path)
