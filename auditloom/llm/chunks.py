"""Documents in chunks of some megabytes, with all words hashed at once in numpy.

A chunk is a group of rows dealt by a hash of the whole row; it is small enough for one task, and
the same in every pass, so passes can answer each other chunk by chunk in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, HASHED_BYTES = 4 << 20, 1 << 17
BASE, STEP, OTHER = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # odd 64-bit constants


def powers(odd: int, n: int) -> np.ndarray:
    """odd**0 to odd**n, mod 2**64."""
    steps = np.full(n + 1, odd, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(OTHER)
    return x ^ (x >> np.uint64(31))


def sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... elements, mod 2**64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, dtype=np.uint64, out=out[1:])
    return out


class Words:
    """Places and hashes of the words of several UTF-8 texts.

    A word's hash is that of its bytes, a difference of running sums. Sums are taken over a
    block at a time, cut between words, so long texts need little more than their own size.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        blank = (self.data == 32) | (self.data - np.uint8(9) < 5)  # below 9 the difference wraps round
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        edges = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, edges)  # first word of each text, and the end
        sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.starts)) - np.repeat(self.first[:-1], sizes)
        self.hashes = np.empty(len(self.starts), np.uint64)
        at, longest = 0, min(HASHED_BYTES, len(self.data))
        if len(self.starts):
            longest = max(longest, int((self.ends - self.starts).max()))
        front, back = powers(BASE, longest), powers(inverse(BASE), longest)
        while at < len(self.starts):
            after = max(int(np.searchsorted(self.ends, self.starts[at] + HASHED_BYTES)), at + 1)
            self.hashes[at:after] = self._hashed(slice(at, after), front, back)
            at = after

    def _hashed(self, some: slice, front: np.ndarray, back: np.ndarray) -> np.ndarray:
        starts, ends = self.starts[some], self.ends[some]
        base, size = starts[0], int(ends[-1] - starts[0])
        letters = self.data[base:base + size].astype(np.uint64) + np.uint64(1)
        letters *= front[:size]
        so_far = sums(letters)
        return mix((so_far[ends - base] - so_far[starts - base]) * back[starts - base] + (ends - starts).astype(np.uint64))


def dealt(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text and chunk; and the bytes of all texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), size


def ordered(table: pa.Table) -> tuple[list[int | None], list[str]]:
    """Ids and texts of a chunk in an order that every pass repeats; null texts as empty."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return [r[0] for r in rows], [r[1] or "" for r in rows]


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values in a sorted array."""
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return ((int(values[s]), s, e) for s, e in zip(edges, edges[1:], strict=False) if e > s)


def rows_of(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array(columns[name], kind) for name, kind in kinds.items()})


def spec(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items())
