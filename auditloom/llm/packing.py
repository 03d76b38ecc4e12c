"""Packing documents into fixed windows of tokens: bounded-space online best fit.

Every partition keeps a fixed number of open windows. Whole windows are cut off a long document as
they are; the rest of it goes to the open window it fills best. If it fits none and all are open,
the fullest is closed. What is still open at the end of a partition is laid end to end with the open
windows of its neighbours. No task holds more than its open windows and one batch of documents.

Defined cases: a null text is an empty one (its only token is the end mark); repeated rows and null
ids are packed like any others; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import text_batches
from auditloom.session import written

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "open boolean")
CACHED_WORDS, CACHED_LENGTH, CODED_AT_ONCE = 300_000, 64, 1 << 21
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
MERGED_PARTITIONS = 8  # partitions whose open windows are merged by one task
NEARLY_FULL, HELD = 0.99, "__held"


class WordTokenizer:
    """Token ids of whole texts as arrays of little-endian 32-bit integers.

    The tokenizer drops white space, lower-cases, and never joins a letter with a full stop or comma
    after it, so a text is the concatenation of its words' ids, and a word ending so is that of its
    letters and the mark. For words of Latin letters its normal form is the lower case and its
    pieces are the whole word, so those steps, the dearest, are skipped. Ids of words are kept
    between texts; the limit bounds memory only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.marks = [b"", *self._coded([".", ","])]

    def _coded(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _coded_letters(self, words: list[str]) -> list[bytes]:
        """Of words that are one piece each: coded as one text, cut after the ids that end a word."""
        ids = np.array(self.letters.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _ids(self, words: list[str], coder: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct words, new ones coded and kept while there is room.

        The first met are mostly the frequent ones. Where texts have changed so much that nine in
        ten distinct words are missed, keeping begins afresh.
        """
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        learnt = dict(zip(new, coder(new), strict=True))
        if len(self.known) >= CACHED_WORDS and 10 * len(new) > 9 * len(words):
            self.known.clear()
        if len(self.known) < CACHED_WORDS:
            self.known.update((w, ids) for w, ids in learnt.items() if len(w) <= CACHED_LENGTH)
        return [learnt[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _forms(self, forms: pa.Array) -> np.ndarray:
        """The ids of distinct words as they stand in the text."""
        letters = pc.match_substring_regex(forms, LATIN)
        words = forms.filter(letters)
        stems = pc.utf8_lower(pc.utf8_rtrim(words, ".,")).dictionary_encode()
        ids = self._ids(_listed(stems.dictionary), self._coded_letters)
        marks = np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), 1,
                         np.where(pc.ends_with(words, ",").to_numpy(zero_copy_only=False), 2, 0))
        out, mask = np.empty(len(forms), object), letters.to_numpy(zero_copy_only=False)
        out[mask] = [ids[k] + self.marks[m] for k, m in zip(stems.indices.to_pylist(), marks.tolist(), strict=True)]
        out[~mask] = self._ids(_listed(forms.filter(pc.invert(letters))), self._coded)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Every distinct word is looked up once for all texts."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        coded = self._forms(words.dictionary)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, starts = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(sizes) - sizes
        places = words.indices.to_numpy()
        lengths = sizes[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[places] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()]
        return [ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def worker_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between tasks."""
    kept = sys.modules.setdefault("__kept_tokenizers__", types.ModuleType("__kept_tokenizers__")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


class Window:
    __slots__ = ("number", "used", "pieces")

    def __init__(self, number: int):
        self.number, self.used, self.pieces = number, 0, []

    def add(self, piece: tuple, length: int) -> None:
        self.pieces.append((*piece, self.number, self.used))
        self.used += length


def _packer(encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], size: int, windows: int, end_id: int) -> Callable:
    end = np.array(end_id, "<u4")
    names = [part.split()[0] for part in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch_of(closed: list[Window], still_open: bool) -> pa.RecordBatch:
        rows = [(*p, still_open) for w in closed for p in w.pieces]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def coded(batch: pa.RecordBatch, encode: Callable) -> Iterator[tuple[int | None, np.ndarray]]:
        doc_ids, texts, length = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids.append(doc_id)
            texts.append(text.as_py() or "")
            length += len(texts[-1])
            if length > CODED_AT_ONCE:
                yield from zip(doc_ids, encode(texts), strict=True)
                doc_ids, texts, length = [], [], 0
        yield from zip(doc_ids, encode(texts), strict=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, opened, made = encoder(), [], TaskContext.get().partitionId() << 33
        for batch in batches:
            closed: list[Window] = []
            waiting = 0
            for doc_id, ids in coded(batch, encode):
                ids = np.append(ids, end)
                total = len(ids)
                for start in range(0, total, size):
                    part = ids[start:start + size].tobytes()
                    length = len(part) // 4
                    best = None
                    if length < size:
                        fitting = [w for w in opened if w.used + length <= size]
                        best = max(fitting, key=lambda w: w.used, default=None)
                    if best is None:
                        best = Window(made)
                        made += 1
                        if length < size:
                            if len(opened) == windows:
                                fullest = max(opened, key=lambda w: w.used)
                                opened.remove(fullest)
                                closed.append(fullest)
                            opened.append(best)
                    best.add((doc_id, start, length, part, total), length)
                    if best.used == size:
                        if length < size:
                            opened.remove(best)
                        closed.append(best)
                waiting += total
                if waiting > 1 << 21:  # a batch of long texts is handed on in parts
                    yield batch_of(closed, False)
                    closed, waiting = [], 0
            yield batch_of(closed, False)
        yield batch_of(opened, True)
        pa.default_memory_pool().release_unused()

    return pack


def pieces_of(docs: DataFrame, tokenizer_path: str, size: int = 2048, windows: int = 64, end_id: int = 1) -> DataFrame:
    """One row per piece with its token ids; ``open`` marks windows to be merged."""
    def encoder() -> Callable[[list[str]], list[np.ndarray]]:
        return worker_tokenizer(tokenizer_path).encode

    text_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_packer(encoder, size, windows, end_id), PIECES)


def merge_open(opened: DataFrame, size: int) -> DataFrame:
    """Open windows of neighbouring partitions laid end to end, cut where a sequence is full.

    A task gets the open windows of eight partitions, a fixed number. Nearly full ones stay as they are.
    """
    def lay(group: pd.DataFrame) -> pd.DataFrame:
        used = group.groupby("sequence_id")["length"].transform("sum")
        ready = group[used >= NEARLY_FULL * size]
        rest = group[used < NEARLY_FULL * size].sort_values(["sequence_id", "offset"])
        numbers = sorted(set(rest["sequence_id"].tolist()))
        rows, at = [], 0
        for r in rest.itertuples(index=False):
            done = 0
            while done < r.length:
                part = min(r.length - done, size - at % size)
                rows.append((r.doc_id, r.start + done, part, r.ids[4 * done:4 * (done + part)], r.doc_tokens,
                             numbers[at // size], at % size))
                done, at = done + part, at + part
        laid = pd.DataFrame(rows, columns=[c for c in group.columns if c != "near"])
        return pd.concat([ready.drop(columns="near"), laid]).astype({"doc_id": "Int64"})

    columns = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    near = F.shiftright(F.col("sequence_id"), 33 + MERGED_PARTITIONS.bit_length() - 1)
    rows = opened.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", near.alias("near"))
    return rows.groupBy("near").applyInPandas(lay, columns)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, windows: int = 64, end_id: int = 1,
         keep: Callable[[DataFrame], DataFrame] = lambda pieces: pieces) -> DataFrame:
    """Pieces with their final sequence. ``keep`` may put other columns in the place of ``ids``."""
    pieces = pieces_of(docs, tokenizer_path, size, windows, end_id)
    held, _ = written(keep(pieces.withColumn(HELD, F.when(F.col("open"), F.col("ids")))))
    opened = held.where("open").withColumn("ids", F.col(HELD))
    return held.where("not open").drop("open", HELD).unionByName(keep(merge_open(opened, size)))
