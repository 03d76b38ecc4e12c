"""Decision diff: align the registers of several runs and label each decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip, text
from auditloom.operators.registers import last_rows


def decision_diff(decisions: DataFrame, by: list[str] | None = None,
                  runs: DataFrame | None = None) -> DataFrame:
    """One row per decision: CONSENSUS when every run chose the same, else DIVERGENCE.

    ``decisions`` carries ``run_id`` and ``row_no``; ``by`` names grouping columns whose values are
    compared separately (for instance ``project_id``). A run without the decision counts as having
    chosen nothing. Decisions nobody filled are left out. ``runs`` lists the compared runs with
    their order ``run_ord``; by default every run of the group, in name order.

    The absent runs are counted, not materialised, so no runs-by-decisions product is built.
    """
    by = by or []
    # Only an absent or empty id is skipped; a blank-but-present one folds to the empty id below.
    rows = decisions.withColumn("did", F.upper(strip(F.col("decision_id")))).filter("did <> ''")
    # The last row of an id is compared; the id stands where the run named it first.
    first = rows.groupBy(*by, "run_id", "did").agg(F.min("row_no").alias("first_row"))
    latest = last_rows(rows, [*by, "run_id", "did"]).join(first, [*by, "run_id", "did"])
    if runs is None:
        runs = decisions.groupBy(*by, "run_id").agg(F.lit(1).alias("one")).select(*by, "run_id")
        latest = latest.withColumn("run_ord", F.col("run_id"))
    else:
        latest = latest.join(runs, [*by, "run_id"])
    compared = runs.groupBy(*by).agg(F.count("*").alias("runs"))
    chosen = strip(F.col("chosen"))
    said = lambda c: F.min_by(F.when(text(F.col(c)) != "", F.col(c)),
                              F.when(text(F.col(c)) != "", F.col("run_ord")))
    per_decision = latest.groupBy(*by, "did").agg(
        F.count("*").alias("present"), F.min(chosen).alias("low"), F.max(chosen).alias("high"),
        said("question").alias("question"), said("stage").alias("stage"),
        F.min(F.struct("run_ord", "first_row")).alias("first_seen"))
    if by:
        joined = per_decision.join(compared, by)
    else:
        joined = per_decision.withColumn("runs", compared.scalar())
    same = (F.col("low") == F.col("high")) & (F.col("present") == F.col("runs"))
    return joined.filter("high <> ''").select(
        *by, F.col("did").alias("decision_id"), F.coalesce("stage", F.lit("")).alias("stage"),
        F.coalesce("question", "did").alias("question"), "runs", "present",
        F.when(same, "CONSENSUS").otherwise("DIVERGENCE").alias("status"), "first_seen")
