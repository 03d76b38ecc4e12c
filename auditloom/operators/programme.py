"""Rules of the candidate programme that exist as written policy: filters and ratios, no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip


def _yes(column: str) -> Column:
    return F.lower(strip(F.col(column))) == "yes"


def admitted(candidates: DataFrame) -> DataFrame:
    """Candidates with a historical record in bulk or archived, held as structured bytes."""
    return candidates.filter((_yes("history_bulk") | _yes("archive_fallback"))
                             & _yes("structured_bytes"))


def eligible(subjects: DataFrame, conditions: list[str]) -> DataFrame:
    """Subjects for which every recorded condition column says yes."""
    met = F.lit(True)
    for name in conditions:
        met = met & _yes(name)
    return subjects.filter(met)


def exit_rates(entries: DataFrame, edge: Column, grace: Column,
               by: list[str] | None = None) -> DataFrame:
    """Exit rate with entries last seen within ``grace`` of the data edge counted or censored.

    ``entries`` has one row per entry with ``last_seen``. Both rates share one denominator.
    """
    gone = F.col("last_seen") < edge
    confirmed = F.col("last_seen") < grace
    counts = entries.groupBy(*(by or [])).agg(
        F.count("*").alias("entries"), F.count_if(gone).alias("exits_counted"),
        F.count_if(confirmed).alias("exits_confirmed"))
    return counts.withColumns({
        "pct_counted": F.round(100 * F.col("exits_counted") / F.col("entries"), 2),
        "pct_confirmed": F.round(100 * F.col("exits_confirmed") / F.col("entries"), 2)})


def runner_measures(events: DataFrame) -> DataFrame:
    """Per run: interventions, corrections and unresolved anchors out of (run_id, kind) events."""
    kind = F.col("kind")
    return events.groupBy("run_id").agg(
        F.count_if(kind == "intervention").alias("interventions"),
        F.count_if(kind == "correction").alias("corrections"),
        F.count_if(kind == "unresolved_anchor").alias("unresolved_anchors"))
