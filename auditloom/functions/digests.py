"""SHA-256 digests of decision rows and of the question-and-scope projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import strip


def decision_row_digest() -> Column:
    """Over the nine stripped decision fields joined by the unit separator."""
    fields = [strip(F.col(name)) for name in fixed.DECISION_COLUMNS]
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def any_match(value: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | value.rlike(pattern)
    return hit
