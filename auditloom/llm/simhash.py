"""Near-duplicates by SimHash: fingerprints, exact comparison in tiles, components.

Fingerprints that differ in at most ``radius`` bits are linked. Distinct fingerprints are laid out in
tiles by the population counts of their four quarters: two fingerprints within the radius have
counts that differ by no more than the radius in sum, so all other tile pairs are skipped. A tile pair is
compared in full with numpy exclusive-or and bit counts; it hands on at most one link per fingerprint
(a spanning forest of what it found), never all pairs of a dense group.

Copies share a fingerprint and are one node, however many they are. The work left is quadratic in the
distinct fingerprints of neighbouring cells; that is the method's own cost.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null
doc_id never is a component's id unless its members have no other; repeated rows are kept in
``near_duplicates``; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.components import components
from auditloom.llm.words import text_batches
from auditloom.session import written

SEED, SHINGLE, RADIUS = 42, 3, 2
TILE = 2048
QUARTERS, BITS = 4, 16
COUNTED_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    last = [e - 1 for e in ends[shingle - 1:]] or [len(joined)]
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip([0, *ends], last, strict=False)),
                         np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED_AT_ONCE):
        octets = hashes[at:at + COUNTED_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return hashed(F.coalesce(text, F.lit("")))


def _count(quarter: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", BITS * quarter).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts with sum at most the radius, one of each pair of opposites."""
    around = range(-radius, radius + 1)
    return [d for d in product(around, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked between two tiles: every node with the least of its group."""
    left, right = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        left.append(i + at)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if same:
        i, j = i[i < j], j[i < j]
        nodes = a
    else:
        j = j + len(a)
        nodes = np.concatenate([a, b])
    group = np.arange(len(nodes))
    while len(i):
        least = np.minimum(group[i], group[j])
        before = group.copy()
        np.minimum.at(group, i, least)
        np.minimum.at(group, j, least)
        group = group[group]
        if np.array_equal(before, group):
            break
    linked = np.unique(np.concatenate([i, j])) if len(i) else np.zeros(0, np.int64)
    linked = linked[group[linked] != linked]
    return nodes[linked].view(np.int64), nodes[group[linked]].view(np.int64)


def links_between(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within the radius."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for mine, theirs, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = mine.values.to_numpy().view(np.uint64)
                y = x if same else theirs.values.to_numpy().view(np.uint64)
                a, b = _forest(x, y, same, radius)
                out_a.append(a)
                out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))],
                                             ["a", "b"])

    base = BITS + 1
    cell = sum((_count(q).cast("int") * base**q for q in range(1, QUARTERS)), _count(0).cast("int"))
    placed = fingerprints.select("fp", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    tiles = (placed.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
             .groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")))
    digits = [F.floor(F.col("cell") / base**q) % base for q in range(QUARTERS)]
    near = []
    for step in _steps(radius):
        inside = F.lit(True)
        for digit, d in zip(digits, step, strict=True):
            inside = inside & (digit + d).between(0, BITS)
        near.append(F.when(inside, F.col("cell") + sum(d * base**q for q, d in enumerate(step))))
    mine = tiles.select("cell", "tile", "fps", F.explode(F.array_compact(F.array(*near))).alias("other"))
    theirs = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("fps").alias("others"))
    pairs = mine.join(theirs, "other").where("other != cell or other_tile >= tile")
    same = (F.col("other") == F.col("cell")) & (F.col("other_tile") == F.col("tile"))
    work = pairs.select("fps", F.when(~same, F.col("others")).alias("others"), same.alias("same"))
    return work.mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links_between(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    text_batches(docs.sparkSession)
    prints, _ = written(docs.select("doc_id", fingerprint_of(F.col("text"), shingle, seed).alias("fp")))
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest doc_id."""
    text_batches(docs.sparkSession)
    printed = docs.withColumn("__fp", fingerprint_of(F.col("text"), shingle, seed))
    prints, _ = written(printed.select("doc_id", F.col("__fp").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    stays = (prints.distinct().join(classes(prints, radius), "fp").groupBy("root").agg(first)
             .select(F.col("first.doc_id").alias("__id"), F.col("first.fp").alias("__own")))
    kept = printed.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__own")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__fp"]).select(*docs.columns)
