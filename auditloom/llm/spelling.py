"""Spelling variants: words that differ by one inserted, deleted or replaced character, and their usual form.

Two words are compared by their common prefix and common suffix: if the lengths of both reach the longer
length minus one, one edit turns one word into the other. Blocks of words are padded code-point matrices,
once from the left and once from the right, and a pair of blocks is compared in full with numpy.

Only blocks that can hold such a pair meet. With the longer length m and s = (m - 1) // 3, two words one edit
apart share their first i * s and last (2 - i) * s characters for some i of 0, 1, 2. So a word takes three keys
for its own length and three for the next one, and no pair is missed. A pair may share several keys; it is
reported under the least i only. Words of a key are laid out in tiles of bounded size, and the tiles of a key
meet in pairs, so no task holds a whole key and a key may hold any share of the words; the comparisons of a
key grow with the square of its words, which is the method's own cost. Small keys are put together in
one matrix. Only near pairs leave a task.

Forms lead from a word to a near word ten times as frequent or more, so chains are short; they are followed by
pointer doubling until nothing changes.

Defined cases: null and empty texts have no runs; a null doc_id counts as empty in the checksum; rows that
repeat are counted each time; a run of any length is one word; ties go to the word that is smaller in code-point
order; no words give no rows; other columns of the documents are not carried, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import written

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, CLEARLY, DELETED = 7, 2, 10, 31
TILE, MATRIX, CELLS = 512, 128, 1 << 20  # words of a tile, of a matrix, and code points of either
PARTS = 2  # of three, that two words one edit apart share


def counted(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts; of some runs, chosen by a checksum, one character is left out."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    long = runs.where(F.char_length("run") >= shortest).select(
        "id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = long.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("length"))
    at = (F.col("h") % F.col("length")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("length")))
    word = F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.char_length("word") >= shortest)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded on the right, the same from the last character on, and the lengths."""
    sizes = np.array([len(w) for w in words])
    left = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    right = np.array([w[::-1] for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)
    return left, right, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common first elements of every row of ``a`` with every row of ``b``; equal rows have all."""
    length = np.full((len(a), len(b)), a.shape[1], np.int64)
    for k in range(a.shape[1] - 1, -1, -1):
        length[a[:, k, None] != b[None, :, k]] = k
    return length


def near_pairs(words: list[str], groups: np.ndarray, longer: np.ndarray, turn: np.ndarray,
               other: tuple[list[str], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart that have the same group, ``longer`` as the longer length and ``turn`` as least i.

    Within one block of words, or between it and another (words and their groups).
    """
    theirs, their_groups = other or (words, groups)
    width = int(max(longer.max(), max(map(len, theirs))))
    left, right, sizes = matrices(words, width)
    left2, right2, sizes2 = matrices(theirs, width)
    prefix, suffix = _common(left, left2), _common(right, right2)
    most = np.maximum(sizes[:, None], sizes2[None, :])
    part = ((longer - 1) // (PARTS + 1))[:, None]
    first = np.full(prefix.shape, PARTS + 1)
    for i in range(PARTS, -1, -1):
        first[(prefix >= i * part) & (suffix >= (PARTS - i) * part)] = i
    same = (groups[:, None] == their_groups[None, :]) & (most == longer[:, None]) & (first == turn[:, None])
    good = same & (prefix + suffix >= most - 1) & ~((prefix >= most) & (sizes[:, None] == sizes2[None, :]))
    a, b = np.nonzero(good)
    if other is None:
        a, b = a[a < b], b[a < b]
    return a, b


def _keys(vocabulary: DataFrame) -> DataFrame:
    """(key, longer, turn, word): the six keys of every word."""
    size = F.char_length("word")
    turns = F.explode(F.array(*[F.struct((size + more).alias("longer"), F.lit(i).alias("turn"))
                                for more in (0, 1) for i in range(PARTS + 1)])).alias("k")
    rows = vocabulary.select("word", turns).select("word", "k.longer", "k.turn")
    part = F.floor((F.col("longer") - 1) / (PARTS + 1)).cast("int")
    head = F.substring(F.col("word"), F.lit(1), F.col("turn") * part)
    tail = F.when(F.col("turn") < PARTS, F.substring(F.col("word"), -(F.lit(PARTS) - F.col("turn")) * part, (F.lit(PARTS) - F.col("turn")) * part)).otherwise("")
    return rows.select(F.struct("longer", "turn", head.alias("head"), tail.alias("tail")).alias("key"), "word")


def near(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): all pairs of distinct words of ``vocabulary`` (word) that are one edit apart, each once."""
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of few words, some at once."""
        for batch in batches:
            left, right = [], []
            lists, longer, turn = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            some, size, width = [], 0, 0

            def compared(some: list[int]) -> None:
                parts = [lists[k].as_py() for k in some]
                of, words = np.repeat(some, [len(p) for p in parts]), [w for p in parts for w in p]
                a, b = near_pairs(words, of, longer[of], turn[of])
                left.extend(words[k] for k in a)
                right.extend(words[k] for k in b)

            counts = np.diff(lists.offsets.to_numpy())
            for k in np.argsort(longer, kind="stable").tolist():
                if some and (size + counts[k] > MATRIX or (size + counts[k]) * max(width, longer[k]) > CELLS):
                    compared(some)
                    some, size, width = [], 0, 0
                some.append(k)
                size, width = size + counts[k], max(width, longer[k])
            if some:
                compared(some)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two tiles of one key, or one with itself."""
        for batch in batches:
            left, right = [], []
            for mine, theirs, longer, turn in zip(*batch.columns, strict=True):
                words, others = mine.as_py(), theirs.as_py()
                step = max(1, min(MATRIX, CELLS // longer.as_py()))
                for start in range(0, len(words), step):
                    some = words[start:start + step]
                    zero, fixed = np.zeros(len(some), np.int64), [np.full(len(some), x.as_py()) for x in (longer, turn)]
                    second = words[start:] if others is None else others
                    a, b = near_pairs(some, zero, *fixed, (second, np.zeros(len(second), np.int64)))
                    if others is None:  # the same words from here on: each pair once
                        a, b = a[a < b], b[a < b]
                    left += [some[k] for k in a]
                    right += [second[k] for k in b]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])

    keyed = _keys(vocabulary)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.lit(CELLS) / F.col("key.longer"))).cast("int")
    fits = (F.col("size") <= MATRIX) & (F.col("size") <= room)
    few = (keyed.join(sizes.where(fits).select("key"), "key").groupBy("key")
           .agg(F.collect_list("word").alias("words")).select("words", "key.longer", "key.turn"))
    many = sizes.where(~fits).select("key", F.ceil(F.col("size") / room).alias("tiles"))
    laid = (keyed.join(many, "key").groupBy("key", "tiles", F.pmod(F.xxhash64("word"), F.col("tiles")).alias("tile"))
            .agg(F.collect_list("word").alias("words")))
    met = laid.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"), "tile", "words")
    one = met.where("tile <= other").select("key", "tile", "other", F.col("words").alias("mine"))
    two = met.where("tile > other").select("key", F.col("other").alias("tile"), F.col("tile").alias("other"), F.col("words").alias("theirs"))
    work = one.join(two, ["key", "tile", "other"], "left").where("theirs IS NOT NULL OR tile = other").select(
        "mine", "theirs", F.col("key.longer").alias("longer"), F.col("key.turn").alias("turn"))
    return few.mapInArrow(small, "a string, b string").unionByName(work.mapInArrow(tiles, "a string, b string"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form."""
    steps, left = forms.select("word", F.col("form").alias("root")), 1
    while left:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = steps.join(ahead, "root", "left")
        steps, seen = written(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                              F.count_if("moved").alias("left"))
        steps, left = steps.select("word", "root"), seen["left"]
    return steps


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, clearly: int = CLEARLY) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text)."""
    vocabulary, _ = written(counted(docs, shortest, least))
    pairs, _ = written(near(vocabulary.select("word")))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    known = both.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = vocabulary.join(best, "word", "left")
    usual = -F.col("best.less") >= F.lit(clearly) * F.col("n")
    rows, _ = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
