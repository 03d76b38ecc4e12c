"""Running totals within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import written

TIE, CHUNK, START, LOCAL = "__tie", "__chunk", "__start", "__local"


def running_totals(df: DataFrame, group: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the group that come before this one.

    Rows are dealt by range over (group, order, a row number that parts equal rows), so a hot group
    or a key repeated many times is spread over as many tasks as its rows need. Each range is
    numbered on its own; one row per group and range carries the totals of the ranges before it.
    The ranges are written to the shared folder, so a lost executor cannot deal rows differently
    the second time. Group columns must not be null.
    """
    ranged = (df.withColumn(TIE, F.monotonically_increasing_id())
              .repartitionByRange(*[F.col(c) for c in (*group, *order, TIE)])
              .withColumn(CHUNK, F.spark_partition_id()))
    held, _ = written(ranged)
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (held.groupBy(*group, CHUNK).agg(F.sum(value).alias(LOCAL))
              .select(*group, CHUNK, F.coalesce(F.sum(LOCAL).over(before), F.lit(0)).alias(START)))
    inside = Window.partitionBy(*group, CHUNK).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn(LOCAL, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(starts, [*group, CHUNK])
            .withColumn(into, F.col(START) + F.col(LOCAL)).select(*df.columns, into))
