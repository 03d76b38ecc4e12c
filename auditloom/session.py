"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

# Runtime settings the jobs rely on. All are ordinary Spark options: adaptive plans so that shuffle
# partitions follow the data, and skew splitting for lookups where one key holds a large share of
# the rows (the other side of those joins has one row per key, so splitting repeats little).
RUNTIME_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Spark puts "the array is there and not empty" in front of every explode, which works out the array two
    # times more; here arrays come from patterns over whole texts, and few are empty.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # Rows that already lie sorted by their group are gathered in one streaming pass. Object hash aggregates give up
    # after 128 groups and sort all rows, once before and once after their shuffle.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # of equal keys in a JSON record the last counts
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        if key.endswith("excludedRules"):  # those of the session stay excluded
            named = [r for r in spark.conf.get(key, "").split(",") if r and r != value]
            value = ",".join([*named, value])
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, laptops) gets a temporary folder; on a cluster
    a missing setting is an error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
    return context.getCheckpointDir()


def written(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
    """Write a frame to the shared folder and read it back; metrics are observed on the way.

    The copy survives lost executors, is computed once, and carries file sizes for the optimizer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), (seen.get if metrics else {})
