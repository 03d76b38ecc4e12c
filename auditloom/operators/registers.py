"""Shared register steps: contract dimensions, stamping, duplicate keys, first and last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.session import written


def contract_decisions(spark: SparkSession) -> DataFrame:
    """The required decisions of every contract (80 rows, fixed), marked for broadcast."""
    rows = []
    for contract in fixed.CONTRACTS:
        changed = fixed.CONTRACT_EXCEPTIONS.get(contract, {})
        for stage, decision_id, question in fixed.REQUIRED_DECISIONS:
            question = changed.get(decision_id, question)
            if question is not None:
                rows.append((contract, stage, fixed.STAGES.index(stage), decision_id, question))
    dim = spark.createDataFrame(
        rows, "contract string, stage string, stage_ord int, decision_id string, question string")
    return F.broadcast(dim)


def stage_order(stage: str) -> int:
    return fixed.STAGES.index(stage)


def stamp(rows: DataFrame, contract: str, through: str = "mint") -> DataFrame:
    """Give a register frame the contract and stage its projects are checked under."""
    return rows.withColumns({"contract": F.lit(contract),
                             "through_ord": F.lit(stage_order(through))})


def with_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add the columns an older or narrower register lacks, empty."""
    missing = {n: F.lit("") for n in names if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def projects_of(rows: DataFrame) -> DataFrame:
    """The projects that have at least one row, with their contract and stage."""
    return rows.groupBy("project_id").agg(
        F.max("contract").alias("contract"), F.max("through_ord").alias("through_ord"))


def gathered(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows grouped after one shuffle and one sort, for lists that hold nearly all of their rows.

    Each row moves as it is, and ``session.configure`` has lists made in one pass over the sorted rows.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys).groupBy(*keys)


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the earliest: an aggregate, so a hot key is reduced before the shuffle."""
    return _pick(rows, keys, F.min_by)


def last_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the latest."""
    return _pick(rows, keys, F.max_by)


def _pick(rows: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col("row_no")).alias("r"))
            .select(*keys, "r.*"))


def repeats(rows: DataFrame, keys: list[str], among: Column | None = None, landed: bool = False) -> DataFrame:
    """The rows whose key an earlier row already used.

    Only keys seen twice or more are joined back, so the join side stays as small as the defect. With
    ``landed`` these keys are written first: where they are few, their known size saves the rows a
    shuffle and a sort. It pays where the rows are at hand and not worked out anew for it.
    """
    pool = rows if among is None else rows.filter(among)
    twice = (pool.groupBy(*keys).agg(F.min("row_no").alias("first_row"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    if landed:
        twice, _ = written(twice)
    return pool.join(twice, keys).filter("row_no > first_row").drop("first_row")
