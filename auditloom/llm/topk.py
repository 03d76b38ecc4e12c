"""Exact top-k inner products by no-random-access aggregation.

In every block of candidates each component has a sorted list. Lists are read from the end that is best for the
query, some further rows each round. A candidate's score is known for the lists it was met in; in
the others it lies between the list's worst value and the value last read. That gives each
candidate a lower and an upper bound. Candidates whose upper bound is below the k-th best lower
bound cannot qualify; reading stops when few others are left, and their scores are resolved.
All queries of a block advance together, so a round is a few matrix products.

Queries come in blocks as well; every pair of blocks is one unit of work of bounded size and yields k
rows per query, which are ranked at the end. Scores are exact: products run in floating point only
while they stay below 2**53, in 64-bit integers otherwise.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; rows that repeat an id count once, with the least vector; shorter vectors are filled with
zeros; ties go to the smaller id; no candidates give no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import written

BLOCK, QUERY_BLOCK = 4096, 256
DEPTHS = (0.25, 0.5, 0.75, 1.0)
LEFT_PER_RESULT = 16  # reading stops when so many candidates per result may still qualify


def _matrix(column: pa.ListScalar, width: int) -> np.ndarray:
    vectors = column.values
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def _width(column: pa.ListScalar) -> int:
    return max(np.diff(column.values.offsets.to_numpy()), default=0)


class Lists:
    """A block of candidates with the place of each in every sorted list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        ranks = np.argsort(np.argsort(vectors, axis=0, kind="stable"), axis=0, kind="stable")
        self.from_low, self.from_high = ranks, len(ids) - 1 - ranks
        self.sorted = np.sort(vectors, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best."""
        n = len(self.ids)
        largest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if largest < 2.0**52 else np.int64
        least = np.finfo(kind).min if kind is np.float64 else np.iinfo(kind).min
        waiting = np.arange(len(query_ids))
        for depth in DEPTHS:
            read = min(n, max(k, int(np.ceil(n * depth))))
            q = queries[waiting].astype(kind)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            met_high, met_low = self.from_high < read, self.from_low < read
            known = (np.where(met_high, self.vectors, 0).astype(kind) @ up.T
                     + np.where(met_low, self.vectors, 0).astype(kind) @ down.T)
            unmet_high, unmet_low = (~met_high).astype(kind), (~met_low).astype(kind)
            last_high, last_low = self.sorted[n - read].astype(kind), self.sorted[read - 1].astype(kind)
            worst_high, worst_low = self.sorted[0].astype(kind), self.sorted[-1].astype(kind)
            upper = known + unmet_high @ (up * last_high).T + unmet_low @ (down * last_low).T
            lower = known + unmet_high @ (up * worst_high).T + unmet_low @ (down * worst_low).T
            own = self.ids[:, None] == query_ids[waiting][None, :]
            lower[own] = least
            bar = np.partition(lower, n - k, axis=0)[n - k] if n >= k else np.full(len(waiting), least)
            may = (upper >= bar) & ~own
            done = may.sum(axis=0) <= LEFT_PER_RESULT * k
            done |= read == n
            for at in np.flatnonzero(done):
                left = np.flatnonzero(may[:, at])
                scores = self.vectors[left] @ queries[waiting[at]]
                best = np.lexsort((self.ids[left], -scores))[:k]
                yield int(query_ids[waiting[at]]), self.ids[left][best], scores[best]
            waiting = waiting[~done]
            if not len(waiting):
                return


def scaled(vectors: DataFrame, vector: Column, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the rows that take part; v = floor(scale * x)."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & vector.isNotNull() & good)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from tables (vec_id, v) of whole numbers."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, query_ids, asked in zip(*batch.columns, strict=True):
                width = max(_width(vectors), _width(asked))
                lists = Lists(ids.values.to_numpy(), _matrix(vectors, width))
                found = list(lists.search(query_ids.values.to_numpy(), _matrix(asked, width), k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                         pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                        ["query_id", "vec_id", "score"])

    def blocks(rows: DataFrame, size: int, name: str, n: int) -> DataFrame:
        dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // size))))
        return dealt.groupBy(name).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    n, m = candidates.count(), queries.count()
    if not n or not m:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = F.sequence(F.lit(0), F.lit(-(-m // query_block) - 1)).cast("array<long>")
    left = blocks(candidates, block, "block", n).withColumn("query_block", F.explode(every))
    right = blocks(queries, query_block, "query_block", m).withColumnRenamed("rows", "asked")
    pairs = left.join(right, "query_block")
    work = pairs.repartition(-(-n // block) * -(-m // query_block), "block", "query_block").select(
        "rows.vec_id", "rows.v", F.col("asked.vec_id").alias("query_ids"), F.col("asked.v").alias("asked"))
    best = work.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` ask; all rows but their own answer."""
    rows, _ = written(scaled(vectors, F.col(vector)))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
