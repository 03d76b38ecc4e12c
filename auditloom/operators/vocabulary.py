"""Controlled vocabulary: register values against the values a project declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip, text
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import projects_of

ARM = "VOCAB"
KEYS = ["project_id", "row_no", "contract", "through_ord", "named", "extra"]
SHARES = 256  # into which the rows of a project are dealt: one project may hold them all


def _cell(rows: DataFrame, name: Column) -> Column:
    """The cell of the column called ``name``; null where the row's file has no such column."""
    cell = F.when(F.lit(False), F.lit(None).cast("string"))
    for column in rows.columns:
        if column not in KEYS:
            cell = cell.when(name == column, text(F.col(column)))
    if "named" in rows.columns:
        cell = F.when(F.array_contains("named", name), cell)
    if "extra" in rows.columns:
        cell = F.coalesce(cell, F.when(F.map_contains_key("extra", name), text(F.try_element_at("extra", name))))
    return cell


def _dealt(rows: DataFrame) -> DataFrame:
    """Add ``share``, told by the whole row, so that no project and no frequent value is one task's."""
    plain = [F.to_json("extra") if c == "extra" else F.col(c) for c in rows.columns]
    return rows.withColumn("share", F.pmod(F.xxhash64(*plain), F.lit(SHARES)).cast("int"))


def _in_every_share(declarations: DataFrame) -> DataFrame:
    """Declarations, small beside the rows they are met by, once for each share."""
    return declarations.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))


def melted(vocabulary: DataFrame, registers: dict[str, DataFrame]) -> DataFrame:
    """(project_id, register, row_no, column, value, share) for every field its project controls.

    A row meets the list of its project's controlled columns and reads these cells alone; other cells
    are never copied into a list. Columns are exploded before their cells are read, in compiled code.
    """
    lists = _in_every_share(declared(vocabulary).groupBy("project_id").agg(F.collect_set("column").alias("controlled")))
    frames = []
    for name, rows in registers.items():
        met = _dealt(rows).join(lists, ["project_id", "share"]).withColumn("_column", F.explode("controlled"))
        cells = met.select("project_id", F.lit(name).alias("register"), "row_no", F.col("_column").alias("column"),
                           _cell(rows, F.col("_column")).alias("value"), "share")
        frames.append(cells.filter("value IS NOT NULL").withColumn("value", strip(F.col("value"))))
    return union_all(frames)


def declared(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(
        "project_id", strip(F.col("column")).alias("column"),
        strip(F.col("value")).alias("value")).filter(F.col("column") != "").distinct()


def undeclared_values(vocabulary: DataFrame, registers: dict[str, DataFrame]) -> DataFrame:
    """Register fields in a controlled column whose value the project does not declare."""
    allowed = _in_every_share(declared(vocabulary))
    return melted(vocabulary, registers).join(allowed, ["project_id", "column", "value", "share"], "left_anti").drop("share")


def checked_counts(vocabulary: DataFrame, registers: dict[str, DataFrame]) -> DataFrame:
    """Per project: values checked and the controlled columns, sorted.

    Values are counted per column before the project is put together, so only one row per column
    reaches the list.
    """
    controlled = declared(vocabulary).select("project_id", "column").distinct()
    fields = melted(vocabulary, registers)
    per_column = fields.groupBy("project_id", "column").agg(F.count("*").alias("n"))
    return (controlled.join(per_column, ["project_id", "column"], "left")
            .groupBy("project_id")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                 F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns")))


def vocabulary_findings(vocabulary: DataFrame, registers: dict[str, DataFrame]) -> DataFrame:
    """``vocabulary`` carries contract and through_ord; arms without vocabulary rows are skipped."""
    named = declared(vocabulary).select("project_id").distinct()
    no_column = projects_of(vocabulary).join(named, "project_id", "left_anti")
    note = F.format_string("checked=%d columns=%s", "checked", "columns")
    bad = undeclared_values(vocabulary, registers)
    return union_all([
        apply_rules(no_column, ARM, [Rule("no_controlled_column", F.lit(True))]),
        apply_rules(bad, ARM, [Rule("undeclared_value", F.lit(True), F.concat_ws(
            " ", "column", "value"))], F.col("register"), F.col("row_no")),
        apply_rules(checked_counts(vocabulary, registers), ARM,
                    [Rule("checked", F.lit(True), note, "note")]),
    ])
