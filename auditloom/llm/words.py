"""Words and small expression helpers the operators share.

A word is a maximal run of characters other than space and the five ASCII controls tab to carriage
return. Python's ``bytes.split`` cuts at exactly these, so UTF-8 text is split as bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows to Python at once: a row is a whole text, and batches are memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
