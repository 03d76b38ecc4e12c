"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | before) = P(class | before) * P(token | class). The first factor is a softmax over classes; its
weights sit in a table of hashed features of what came before: the last token, the last two, and
the second, third and fourth last alone (skips). It is trained in rounds: shards of the training
documents, made by a hash, take gradient steps on mini-batches from the weights of the round before,
and what they arrive at is averaged, feature by feature, by how often each shard met the feature. All
orders are fixed, so scores do not depend on how files are laid out. The second factor is the
maximum-entropy model with one feature per token, whose fit has a closed form (relative counts,
smoothed by 0.1, with room for unknown tokens), so both factors sum to one.

Tokens belong to a class by their last letters (512 hashed suffixes). Classes are groups of suffixes
that follow one another alike, found from the corpus's suffix-by-suffix counts. Token counts take
one exchange: a chunk sends its distinct token hashes with counts and gets the corpus counts back
in the same order. Driver-side tables have fixed sizes (512 * 512 counts, 16384 * 32 weights).

Defined cases: a null or blank text is one end token; a null doc_id counts as held out; repeated rows are
scored and learnt from each; without training documents every score is that of the uniform start;
other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.chunks import BASE, CHUNK_BYTES, OTHER, STEP, Words, dealt, mix, ordered, rows_of, runs, spec
from auditloom.llm.words import text_batches
from auditloom.session import written

CLASSES, SUFFIXES, FEATURES, KINDS = 32, 512, 1 << 14, 5  # FEATURES at most 2**16
BATCH, SLICE_BYTES, RATE, BLOCK = 4096, 1 << 20, 0.3, 256
ROUNDS, SHARD_CHUNKS, FEW = 4, 4, 8
SMOOTH, BUCKET_TOKENS = 0.1, 8 << 20
END, BEFORE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tokens:
    """Tokens of several texts: the words in lower case and one end each."""

    def __init__(self, texts: list[str]):
        words = Words([t.encode().lower() for t in texts])
        docs = np.arange(len(texts))
        at = np.arange(len(words.hashes)) + words.doc  # one end before each further document
        ends = words.first[1:] + docs
        n = len(words.hashes) + len(texts)
        self.hashes, self.suffix, self.doc = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
        self.hashes[at], self.hashes[ends] = words.hashes, END
        self.doc[at], self.doc[ends] = words.doc, docs
        last = np.zeros(len(words.hashes), np.uint64)
        size = words.ends - words.starts
        for back in (1, 2, 3):
            byte = words.data[words.ends - np.minimum(back, size)].astype(np.uint64)
            last = last * np.uint64(256) + np.where(size >= back, byte, np.uint64(0))
        self.suffix[at] = (mix(last + np.uint64(1)) % np.uint64(SUFFIXES - 1)).astype(np.int64)
        self.suffix[ends] = SUFFIXES - 1

    def before(self, steps: int) -> np.ndarray:
        """Hash of the token so many steps back, or the mark that the text had not begun."""
        out = np.full(len(self.hashes), BEFORE)
        same = self.doc[steps:] == self.doc[:-steps]
        out[steps:][same] = self.hashes[:-steps][same]
        return out

    def features(self) -> np.ndarray:
        one, two = self.before(1), self.before(2)
        seeds = (one, mix(one * np.uint64(BASE) + two), two * np.uint64(STEP), self.before(3) * np.uint64(OTHER),
                 self.before(4) * np.uint64(BASE ^ 2))
        return np.stack([(mix(s + np.uint64(k)) % np.uint64(FEATURES)).astype(np.uint16)
                         for k, s in enumerate(seeds)], axis=1)


def _narrow(values: np.ndarray) -> bytes:
    return values.astype("<u4" if not len(values) or values.max() < 1 << 32 else "<i8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<i8").astype(np.int64)


def _distinct(tokens: Tokens, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every, inverse = np.unique(tokens.hashes, return_inverse=True)
    return every, inverse, (every >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)


def token_counts(rows: DataFrame, bits: int) -> DataFrame:
    """Answers (chunk, bucket, counts) and, with chunk -1, token and type counts by suffix."""
    sent = {"bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "suffix": pa.binary()}
    told = {"chunk": pa.int64(), "bucket": pa.int64(), "counts": pa.binary(), "by_suffix": pa.list_(pa.int64())}

    def count(table: pa.Table) -> pa.Table:
        doc_ids, texts = ordered(table)
        tokens, number = Tokens(texts), table.column("chunk")[0].as_py()
        every, inverse, bucket = _distinct(tokens, bits)
        learnt = ~np.array([held_out(d) for d in doc_ids])
        counts = np.bincount(inverse[learnt[tokens.doc]], minlength=len(every))
        suffix = np.zeros(len(every), np.int64)
        suffix[inverse] = tokens.suffix
        out = {name: [] for name in sent}
        for b, s, e in runs(bucket):
            for name, value in zip(sent, (b, number, every[s:e].astype("<u8").tobytes(), _narrow(counts[s:e]),
                                          suffix[s:e].astype("<u2").tobytes()), strict=True):
                out[name].append(value)
        return rows_of(out, sent)

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        counts = [_wide(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        every, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        suffix = np.concatenate([np.frombuffer(s, "<u2") for s in table.column("suffix").to_pylist()])[first]
        n = np.zeros(SUFFIXES, np.int64)
        np.add.at(n, suffix, total)
        v = np.bincount(suffix[total > 0], minlength=SUFFIXES)
        answers = [_narrow(a) for a in np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])]
        bucket = table.column("bucket")[0].as_py()
        return rows_of({"chunk": [*table.column("chunk").to_pylist(), -1], "bucket": [bucket] * (len(keys) + 1),
                        "counts": [*answers, None], "by_suffix": [None] * len(keys) + [[*n.tolist(), *v.tolist()]]}, told)

    return (rows.groupBy("chunk").applyInArrow(count, spec(sent)).groupBy("bucket")
            .applyInArrow(add, "chunk long, bucket long, counts binary, by_suffix array<long>"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Texts of training documents, about a megabyte at a time."""
    texts, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held_out(doc_id):
                continue
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def suffix_pairs(docs: DataFrame) -> np.ndarray:
    """How often each suffix follows each other in the training documents."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SUFFIXES * SUFFIXES, np.int64)
        for texts in _slices(batches):
            tokens = Tokens(texts)
            inside = tokens.doc[1:] == tokens.doc[:-1]
            cell = tokens.suffix[:-1] * SUFFIXES + tokens.suffix[1:]
            counts += np.bincount(cell[inside], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    sums = docs.mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(SUFFIXES * SUFFIXES)
    got = sums.toArrow()  # at most SUFFIXES squared rows
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(SUFFIXES, SUFFIXES)


def suffix_classes(pairs: np.ndarray) -> np.ndarray:
    """A class for every suffix; the end of a text has the last one to itself."""
    total = max(pairs.sum(), 1.0)
    after, ahead = pairs.sum(axis=1) + 1, pairs.sum(axis=0) + 1
    lift = np.log1p(np.hstack([pairs * total / np.outer(after, ahead), pairs.T * total / np.outer(ahead, after)]))
    u, s, _ = np.linalg.svd(lift - lift.mean(axis=0), full_matrices=False)
    points, weight = u[:, :16] * s[:16], np.sqrt(ahead)
    centres = points[np.argsort(-ahead, kind="stable")[:CLASSES - 1]]
    for _ in range(30):
        nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centres)):
            mine = nearest == c
            if mine.any():
                centres[c] = np.average(points[mine], axis=0, weights=weight[mine])
    nearest[SUFFIXES - 1] = CLASSES - 1
    return nearest


def _logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    lines = features.T.astype(np.intp)
    logits = weights.take(lines[0], axis=0)
    logits += bias
    found = np.empty_like(logits)
    for line in lines[1:]:
        logits += weights.take(line, axis=0, out=found, mode="clip")  # without a mode, take copies what it writes to
    logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_softmax(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits = _logits(weights, bias, features)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def softmax(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    odds = _logits(weights, bias, features)
    np.exp(odds, out=odds)
    odds /= odds.sum(axis=1, keepdims=True)
    return odds


def train(rows: DataFrame, chunks: int, classes: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights of all features after one pass over all training documents, in rounds.

    ``rows`` has doc_id, text and chunk. Some chunks together are a shard; a round takes every shard of its turn
    from the weights all earlier rounds have led to, and averages what the shards make of them. Shards are
    made by a hash of the documents, read in a fixed order and added in a fixed order, so the weights do not
    depend on how the documents are laid out in files or tasks.
    """
    part = {"block": pa.int64(), "shard": pa.int64(), "weights": pa.binary(), "squares": pa.binary(), "met": pa.binary()}
    weights, squares = np.zeros((FEATURES, CLASSES), np.float32), np.full((FEATURES, CLASSES), 1e-2, np.float32)
    shards = -(-chunks // SHARD_CHUNKS)
    rounds = min(ROUNDS, shards)
    dealt_rows = rows.withColumn("shard", F.floor(F.col("chunk") / SHARD_CHUNKS))
    for turn in range(rounds):
        def learn(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            shuffle, own_weights, own_squares = np.random.default_rng(shard), weights.copy(), squares.copy()
            met = np.zeros(FEATURES, np.int64)
            for texts in _training_slices(*ordered(table)):
                _step(own_weights, own_squares, met, texts, classes, bias, shuffle)
            out = {name: [] for name in part}
            for block in range(0, FEATURES, BLOCK):
                n = met[block:block + BLOCK]
                if n.any():
                    for name, value in zip(part, (block, shard, own_weights[block:block + BLOCK].astype("<f4").tobytes(),
                                                  own_squares[block:block + BLOCK].astype("<f4").tobytes(), n.astype("<i8").tobytes()), strict=True):
                        out[name].append(value)
            return rows_of(out, part)

        def average(table: pa.Table) -> pa.Table:
            """One block's mean over the shards, by how often each met a feature; shards in their order."""
            order = np.argsort(table.column("shard").to_numpy(), kind="stable").tolist()
            met = np.array([np.frombuffer(table.column("met")[k].as_py(), "<i8") for k in order]).astype(float)
            means = []
            for name in ("weights", "squares"):
                total = np.zeros((met.shape[1], CLASSES))
                for k, n in zip(order, met, strict=True):
                    total += np.frombuffer(table.column(name)[k].as_py(), "<f4").reshape(-1, CLASSES) * n[:, None]
                means.append((total / np.maximum(met.sum(axis=0), 1)[:, None]).astype("<f4").tobytes())
            return rows_of({"block": [table.column("block")[0].as_py()], "shard": [-1], "weights": [means[0]], "squares": [means[1]],
                            "met": [met.sum(axis=0).astype("<i8").tobytes()]}, part)

        mine = dealt_rows.where(F.col("shard") % rounds == turn)
        parts = mine.groupBy("shard").applyInArrow(learn, spec(part)).groupBy("block").applyInArrow(average, spec(part))
        for row in parts.toArrow().to_pylist():  # FEATURES / BLOCK rows
            seen = np.frombuffer(row["met"], "<i8") > 0
            for into, name in ((weights, "weights"), (squares, "squares")):
                into[row["block"]:row["block"] + BLOCK][seen] = np.frombuffer(row[name], "<f4").reshape(-1, CLASSES)[seen]
    return weights


def _training_slices(doc_ids: list[int | None], texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for doc_id, text in zip(doc_ids, texts, strict=True):
        if not held_out(doc_id):
            some.append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


def _sums_by_feature(slope: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features met, how often, and the slopes of their tokens summed; those met most often come first.

    Most features are met once or a few times in a batch: their first tokens are added for all at once, then their
    second ones, and so on. Only the others are summed feature by feature. The order within a sum is that of reduceat.
    """
    flat = features.ravel()
    by_feature = np.argsort(flat, kind="stable")
    lines, token = flat[by_feature], by_feature // features.shape[1]
    first = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
    n = np.diff(np.r_[first, len(lines)])
    falling = np.argsort((FEW + 1 - np.minimum(n, FEW + 1)).astype(np.uint8), kind="stable")
    first, n = first[falling], n[falling]
    above = len(n) - np.cumsum(np.bincount(np.minimum(n, FEW + 1), minlength=FEW + 2))  # above[k]: met more than k times
    own, sums = lines[first].astype(np.intp), slope.take(token[first], axis=0)
    often, twice = int(above[FEW]), int(above[1])
    if often:
        start = np.cumsum(n[:often]) - n[:often]
        places = np.repeat(first[:often] - start, n[:often]) + np.arange(n[:often].sum())
        sums[:often] = np.add.reduceat(slope.take(token[places], axis=0), start, axis=0)
    more = slope.take(token[first[often:twice] + 1], axis=0)
    for k in range(2, FEW):
        last = int(above[k])
        more[:last - often] += slope.take(token[first[often:last] + k], axis=0)
    sums[often:twice] += more
    return own, n, sums


def _step(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, texts: list[str], classes: np.ndarray, bias: np.ndarray,
          shuffle: np.random.Generator) -> None:
    """Gradient steps over the tokens of some texts, in mini-batches; the arrays are changed in place."""
    tokens = Tokens(texts)
    features, target = tokens.features(), classes[tokens.suffix]
    shuffled = shuffle.permutation(len(target))
    for at in range(0, len(target), BATCH):
        rows = shuffled[at:at + BATCH]
        seen = features.take(rows, axis=0)
        slope = softmax(weights, bias, seen)
        slope[np.arange(len(rows)), target[rows]] -= 1
        own, n, sums = _sums_by_feature(slope, seen)
        square = squares.take(own, axis=0)
        square += sums * sums
        squares[own] = square
        sums *= RATE
        sums /= np.sqrt(square, out=square)
        weights[own] = weights.take(own, axis=0) - sums
        met[own] += n


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    text_batches(docs.sparkSession)
    rows, size = dealt(docs)
    bits = max(0, (size // 6 // BUCKET_TOKENS).bit_length())
    counted, _ = written(token_counts(rows, bits))
    by_suffix = (counted.where("chunk = -1").select(F.posexplode("by_suffix").alias("k", "n"))
                 .groupBy("k").agg(F.sum("n").alias("n")).toArrow())  # 2 * SUFFIXES rows
    sums = np.zeros(2 * SUFFIXES)
    sums[by_suffix.column("k").to_numpy()] = by_suffix.column("n").to_numpy()
    tokens_of, types_of = sums[:SUFFIXES], sums[SUFFIXES:]
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    classes = suffix_classes(suffix_pairs(narrow))
    n = np.bincount(classes, weights=tokens_of, minlength=CLASSES)
    v = np.bincount(classes, weights=types_of, minlength=CLASSES)
    bias = np.log((n + 1) / (n.sum() + CLASSES)).astype(np.float32)
    weights = train(rows, max(1, -(-size // CHUNK_BYTES)), classes, bias)
    total, types = float(n.sum()), float(v.sum())
    room = np.log10(n + SMOOTH * (v + 1))
    base_room = np.log10(total + SMOOTH * (types + 1))
    result = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
              "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, texts = ordered(left)
        if not doc_ids:
            return rows_of({name: [] for name in result}, result)
        tokens = Tokens(texts)
        every, inverse, bucket = _distinct(tokens, bits)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts = np.zeros(len(every), np.int64)
        for b, s, e in runs(bucket):
            counts[s:e] = _wide(answers[b], e - s)
        counts = counts[inverse]
        docs_of, m = tokens.doc, len(doc_ids)
        length = np.bincount(docs_of, minlength=m)
        own = np.log10(counts + SMOOTH)
        target, features = classes[tokens.suffix], tokens.features()
        chosen = np.empty(len(target))
        for at in range(0, len(target), BATCH):
            logs = log_softmax(weights, bias, features[at:at + BATCH])
            chosen[at:at + BATCH] = logs[np.arange(len(logs)), target[at:at + BATCH]]
        base = np.bincount(docs_of, weights=own, minlength=m) - length * base_room
        full = np.bincount(docs_of, weights=own - room[target] + chosen / np.log(10), minlength=m)
        known = np.bincount(docs_of, weights=counts > 0, minlength=m)
        return rows_of({"doc_id": doc_ids, "held_out": [held_out(d) for d in doc_ids], "n_tokens": length.tolist(),
                        "n_known": known.astype(np.int64).tolist(), "train_tokens": [int(total)] * m,
                        "base_score": base.tolist(), "score": full.tolist()}, result)

    replies = counted.where("chunk >= 0").select("chunk", "bucket", "counts")
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, spec(result))
