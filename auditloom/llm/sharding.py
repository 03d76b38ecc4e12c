"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row follows from its key and the number of shards alone, without a ring table. When
a shard is appended, the rows that move all move into it, and they are the fraction it has to hold.

Defined cases: a null key is sharded as key 0; rows with equal keys share a shard; integers are used
as they are and other keys by their 64-bit hash; an empty table gives an empty result; columns named
like the results (``shard``, ``slot``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.prefix import running_totals

MULTIPLIER = np.uint64(2862933555777941757)  # fixed value of the published algorithm


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every key (unsigned 64 bit)."""
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        at[going] = ahead[going]
        with np.errstate(over="ignore"):
            state[going] = state[going] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((at[going] + 1) * step).astype(np.int64)
        going = going[ahead[going] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return assign(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All rows and columns with ``shard``."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    return df.withColumn("shard", shard_of(F.col(key) if whole else F.xxhash64(key), shards))


def number_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: the row's place in its shard, from 0 without gaps, in the given order."""
    return running_totals(df.drop("slot"), ["shard"], order, F.lit(1), "slot")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> None:
    """Write the rows below ``path``, one folder per shard with up to ``files`` files in each."""
    dealt = assign_shards(df, shards, key)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    dealt.repartition(shards * files, "shard", salt).write.partitionBy("shard").parquet(path)
