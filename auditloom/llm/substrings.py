"""Substring deduplication with fixed-block anchors.

Every document contributes its non-overlapping blocks of ``(window + 1) / 2`` words to an index. Whatever a window
of 13 words shares with another document holds one whole block (7 words) of that document, so
probing the index with every rolling block finds all places where a repeat can lie. Around those
hits, and only there, whole windows are compared; windows that repeat one of a smaller doc_id are
joined to maximal repeats and their words removed.

Documents are dealt into chunks of some megabytes. A chunk sends each bucket of the index its
distinct block hashes, sorted, four bytes each, so a passage that stands in a third of all documents
costs one entry per chunk. The answer is one bit per entry. Windows go the same way with
64-bit hashes (beside the bits that chose the bucket) and the chunk's smallest doc_id; the answer is
the hashes that a smaller doc_id has elsewhere. Nothing is ever paired.

Defined cases: a null text has no words; a row with a null doc_id neither loses words nor takes any
from others; rows that repeat a doc_id are one document and take nothing from each other; an empty
table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.chunks import BASE, CHUNK_BYTES, OTHER, STEP, Words, dealt, inverse, mix, ordered, powers, rows_of, runs, spec, sums

WINDOW = 13
BUCKET_WORDS = 2 << 20
NO_DOC = np.iinfo(np.int64).max


class Chunk:
    """The words of a chunk's documents as hashes."""

    def __init__(self, table: pa.Table):
        self.doc_ids, texts = ordered(table)
        self.texts = [t.encode() for t in texts]
        words = Words(self.texts)
        self.words, self.first, self.doc, self.place = words.hashes, words.first, words.doc, words.place
        ids = np.array([NO_DOC if d is None else d for d in self.doc_ids], np.int64)
        self.word_doc = ids[self.doc] if len(ids) else np.zeros(0, np.int64)

    def rolling(self, length: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all runs of ``length`` words inside one document, and their hashes."""
        n = len(self.words)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        so_far = sums(self.words * powers(odd, n - 1))
        hashes = mix((so_far[length:] - so_far[:-length]) * powers(inverse(odd), n)[:n - length + 1])
        at = np.flatnonzero(self.doc[:n - length + 1] == self.doc[length - 1:])
        return at, hashes[at]

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rolling(length, STEP)

    def windows(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, buckets and 64-bit hashes of all windows."""
        at, hashes = self.rolling(length, BASE)
        return at, _bucket(self.rolling(length, OTHER)[1], bits), hashes


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _block_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 further bits of a block's hash; sorting them sorts by bucket."""
    return hashes >> np.uint64(32 - bits)


def _unique_blocks(chunk: Chunk, block: int, bits: int) -> tuple[np.ndarray, ...]:
    at, hashes = chunk.blocks(block)
    keys, inverse = np.unique(_block_keys(hashes, bits), return_inverse=True)
    owner = np.full(len(keys), -1, np.int64)
    docs = chunk.doc[at]
    owner[inverse] = docs
    several = np.zeros(len(keys), bool)
    several[inverse[owner[inverse] != docs]] = True
    indexed = np.zeros(len(keys), bool)
    indexed[inverse[chunk.place[at] % block == 0]] = True
    return at, keys, inverse, several, indexed


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words left joined by one space."""
    block = (window + 1) // 2
    rows, size = dealt(docs, chunk_bytes)
    bits = max(0, (size // 6 // bucket_words).bit_length())

    sent = {"bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "indexed": pa.binary(), "several": pa.binary()}
    asked = {"bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "docs": pa.binary()}
    hit = {"chunk": pa.int64(), "bucket": pa.int64(), "hits": pa.binary()}
    repeated = {"chunk": pa.int64(), "keys": pa.binary()}
    result = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}

    def index(table: pa.Table) -> pa.Table:
        chunk, number = Chunk(table), table.column("chunk")[0].as_py()
        _, keys, _, several, indexed = _unique_blocks(chunk, block, bits)
        out = {name: [] for name in sent}
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        for bucket, s, e in runs((keys >> np.uint64(32)).astype(np.int64)):
            for name, value in zip(sent, (bucket, number, low[s:e].tobytes(), _packed(indexed[s:e]),
                                          _packed(several[s:e])), strict=True):
                out[name].append(value)
        return rows_of(out, sent)

    def probe(table: pa.Table) -> pa.Table:
        """A key is hit if some document has it as a block and another document has it at all."""
        parts = [np.frombuffer(k.as_py(), "<u4") for k in table.column("keys")]
        flags = [(_unpacked(i.as_py(), len(p)), _unpacked(s.as_py(), len(p)))
                 for p, i, s in zip(parts, table.column("indexed"), table.column("several"), strict=True)]
        every, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        indexed, several = np.zeros(len(every), bool), times > 1
        indexed[inverse[np.concatenate([f[0] for f in flags])]] = True
        several[inverse[np.concatenate([f[1] for f in flags])]] = True
        hits = (indexed & several)[inverse]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return rows_of({"chunk": table.column("chunk").to_pylist(), "bucket": table.column("bucket").to_pylist(),
                      "hits": [_packed(h) for h in np.split(hits, ends)]}, hit)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in asked}
        if not left.num_rows or not right.num_rows:
            return rows_of(out, asked)
        chunk, number = Chunk(left), left.column("chunk")[0].as_py()
        at, keys, inverse, _, _ = _unique_blocks(chunk, block, bits)
        hits = np.zeros(len(keys), bool)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("hits").to_pylist(), strict=True))
        for bucket, s, e in runs((keys >> np.uint64(32)).astype(np.int64)):
            hits[s:e] = _unpacked(answers[bucket], e - s)
        marks = np.zeros(len(chunk.words) + 1, np.int64)
        marks[at[hits[inverse]] + 1] = 1
        marks = np.cumsum(marks)  # hits before each word
        start, bucket, hashes = chunk.windows(window, bits)
        near = marks[start + window - block + 1] > marks[start]
        near &= chunk.word_doc[start] != NO_DOC
        bucket, hashes, ids = bucket[near], hashes[near], chunk.word_doc[start[near]]
        order = np.lexsort((ids, hashes, bucket))
        bucket, hashes, ids = bucket[order], hashes[order], ids[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        bucket, hashes, ids = bucket[fresh], hashes[fresh], ids[fresh]  # the smallest doc_id of each
        for b, s, e in runs(bucket):
            least = ids[s:e].min()
            span = ids[s:e] - least
            narrow = span.astype("<u4" if span.max() < 1 << 32 else "<i8").tobytes()
            for name, value in zip(asked, (b, number, hashes[s:e].astype("<u8").tobytes(),
                                           int(least).to_bytes(8, "little", signed=True) + narrow), strict=True):
                out[name].append(value)
        return rows_of(out, asked)

    def settle(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k.as_py(), "<u8") for k in table.column("keys")]
        ids = []
        for part, packed in zip(parts, table.column("docs"), strict=True):
            raw = packed.as_py()
            kind = "<u4" if len(raw) - 8 == 4 * len(part) else "<i8"
            ids.append(np.frombuffer(raw, kind, offset=8).astype(np.int64) + int.from_bytes(raw[:8], "little", signed=True))
        every, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate(ids)
        least = np.full(len(every), NO_DOC, np.int64)
        np.minimum.at(least, inverse, own)
        later = np.split(least[inverse] < own, np.cumsum([len(p) for p in parts])[:-1])
        return rows_of({"chunk": table.column("chunk").to_pylist(),
                      "keys": [p[x].tobytes() for p, x in zip(parts, later, strict=True)]}, repeated)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in result}
        if not left.num_rows:
            return rows_of(out, result)
        chunk = Chunk(left)
        start, _, hashes = chunk.windows(window, bits)
        known = start[chunk.word_doc[start] != NO_DOC]
        hashes, start = hashes[chunk.word_doc[start] != NO_DOC], known
        every, inverse = np.unique(hashes, return_inverse=True)
        elsewhere = np.zeros(len(every), bool)
        if right.num_rows:
            told = np.frombuffer(b"".join(right.column("keys").to_pylist()), "<u8")
            elsewhere = np.isin(every, told)
        least = np.full(len(every), NO_DOC, np.int64)
        np.minimum.at(least, inverse, chunk.word_doc[start])
        # A smaller doc_id has the window in another chunk, or in this one.
        gone = start[elsewhere[inverse] | (least[inverse] < chunk.word_doc[start])]
        edge = np.zeros(len(chunk.words) + window + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        covered = np.cumsum(edge)[:len(chunk.words)] > 0
        for k, text in enumerate(chunk.texts):
            words, lost = text.split(), covered[chunk.first[k]:chunk.first[k + 1]]
            removed = int(lost.sum())
            if removed:
                kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            else:
                kept = words
            for name, value in zip(result, (chunk.doc_ids[k], len(words), removed, b" ".join(kept).decode()), strict=True):
                out[name].append(value)
        return rows_of(out, result)

    hits = rows.groupBy("chunk").applyInArrow(index, spec(sent)).groupBy("bucket").applyInArrow(probe, spec(hit))
    windows = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, spec(asked))
    repeats = windows.groupBy("bucket").applyInArrow(settle, spec(repeated))
    return rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(remove, spec(result))
