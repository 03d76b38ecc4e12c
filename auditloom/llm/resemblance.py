"""Near-duplicates by Jaccard similarity of word shingles: two searches for candidates, exact verification, components.

Candidates come from two searches, neither of which forms all pairs of a group:

- SimHash fingerprints of the shingles, compared in tiles (``simhash.links_between``);
- min-hash forests: in each of some trees, texts with equal first min-hashes meet. A group that is too large for
  one block is split by further min-hashes of the tree, and where even all of them are equal into blocks
  that share one leader. Inside a block all signatures are compared with numpy, and only a spanning forest of the
  pairs that look similar leaves it, the most similar first. So a tree gives fewer pairs than it has texts.

That leaves out pairs of a large group, so a last pass compares them: texts that meet in a tree and lie in different
components by then are laid out in tiles, and all tiles of a group are compared with each other, the whole sets of
pairs from two components included (``missed_links``). So every pair that meets in a tree is either connected
or compared. The work of this pass is quadratic in the components of a group only; a tile is bounded in texts and bytes.

A pair is a link if the whole sets reach the similarity, in exact whole numbers. Links are never wrong; a pair
at the similarity may be missed if it meets in no tree: ``recall`` gives the chance of one tree's first
min-hashes, and the tests and the README the share of linked texts that is found.

Texts with equal sets are one node, however many they are. Defined cases: texts shorter than a shingle
are one shingle; blank and null texts have the empty set and are copies of each other; null doc_ids come last;
rows repeated with one id and one set count once; columns of any names are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm import simhash
from auditloom.llm.chunks import BASE, Words, mix
from auditloom.llm.components import components
from auditloom.llm.words import text_batches
from auditloom.session import written

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity 4 / 5
SLICE_BYTES = 1 << 18  # hashing takes some 60 bytes of memory for each
RADIUS = 2  # of the fingerprints
BATCH_ROWS = 200  # handed to Python at once: two whole sets are a row of the last check
TREES, LEVELS = 14, (4, 6, 8)  # min-hashes of a tree that must be equal, level by level
SIGNATURE, BLOCK, LOOKS = 128, 64, 0.68  # bytes compared, texts of a block, share of them that must be equal
TILE, TILE_BYTES, FAR = 32, 1 << 17, 0.6  # of the last pass: texts and bytes of a tile, share equal below which no pair at the similarity lies (1e-7)


def recall(similarity: float, level: int = LEVELS[0], trees: int = TREES) -> float:
    """The chance that two texts of this similarity meet in some tree at the level."""
    return 1 - (1 - similarity**level) ** trees


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the distinct shingles of every text, sorted."""
    words = Words([t.encode().lower() for t in texts])
    sizes = np.diff(words.first)
    left = np.repeat(sizes, sizes) - words.place
    hashes = np.zeros(len(words.hashes), np.uint64)
    for k in range(width):
        at = np.flatnonzero(left > k)
        hashes[at] = mix(hashes[at] * np.uint64(BASE) + words.hashes[at + k])
    starts = (left >= width) | (words.place == 0)
    doc, hashes = words.doc[starts], hashes[starts]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def node_ids(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit digest of each text's set."""
    total, sizes = np.zeros(n, np.uint64), np.bincount(doc, minlength=n).astype(np.uint64)
    np.add.at(total, doc, mix(hashes + np.uint64(BASE)))
    return mix(total + sizes).view(np.int64)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= SLICE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def node_of(text: Column, width: int = SHINGLE) -> Column:
    """The digest of the text's set."""
    @F.pandas_udf("long")
    def digests(texts: pd.Series) -> pd.Series:
        parts = [node_ids(*shingles(s, width), len(s)) for s in _slices(texts.tolist())]
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *parts]))

    return digests(text.cast("string"))


def min_hashes(doc: np.ndarray, hashes: np.ndarray, n: int, count: int) -> np.ndarray:
    """``count`` min-hashes of every text, a row each; a text without shingles has the largest number."""
    out = np.full((count, n), 0xFFFFFFFF, np.uint32)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        odd = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
        for k in range(count):
            out[k, doc[first]] = np.minimum.reduceat(((hashes * odd[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out.T


def _print_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, fp, signature, and for every tree its keys at the levels."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for some in _slices(batch.column(1).to_pylist()):
                n = len(some)
                doc, hashes = shingles(some, width)
                least = min_hashes(doc, hashes, n, max(SIGNATURE, TREES * LEVELS[-1]))
                parts = np.split(hashes, np.cumsum(np.bincount(doc, minlength=n))[:-1])
                keys = np.zeros((n, TREES, len(LEVELS)), np.uint64)
                for tree in range(TREES):
                    key = np.full(n, tree, np.uint64)
                    for k in range(LEVELS[-1]):
                        key = mix(key * np.uint64(BASE) + least[:, tree * LEVELS[-1] + k])
                        if k + 1 in LEVELS:
                            keys[:, tree, LEVELS.index(k + 1)] = key
                signatures = (least[:, :SIGNATURE] & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(node_ids(doc, hashes, n)), pa.array([_print_of(p) for p in parts], pa.int64()),
                     pa.array([s.tobytes() for s in signatures], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (TREES * len(LEVELS)), keys.view(np.int64).ravel())],
                    ["doc_id", "node", "fp", "signature", "keys"])
                at += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        mapped, "doc_id long, node long, fp long, signature binary, keys array<long>")


def forest(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a block whose signatures look similar, the most similar pairs first."""
    equal = (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2, dtype=np.int32)
    a, b = np.nonzero(np.triu(equal >= LOOKS * signatures.shape[1], 1))
    order = np.argsort(-equal[a, b], kind="stable")
    root, out = list(range(len(nodes))), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v:
            root[u] = v
            out.append((x, y))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of nodes (node, signature, keys) that look similar in some tree."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, signatures in zip(*batch.columns, strict=True):
                a, b = forest(ids.values.to_numpy(), np.frombuffer(b"".join(signatures.as_py()), np.uint8).reshape(len(ids.values), -1))
                left.append(a)
                right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    size = len(LEVELS)
    names = [f"k{k}" for k in range(size)]
    keyed = nodes.select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("keys", t * size + 1, size))).alias("k")).select(
        "node", *[F.get("k", k).alias(n) for k, n in enumerate(names)])

    def shared(rows: DataFrame, name: str) -> DataFrame:
        """The rows whose key occurs twice or more, and how often."""
        return rows.join(rows.groupBy(name).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), name)

    groups, left = [], keyed
    for k, name in enumerate(names):  # what is too many for a block goes on to the next level
        met, _ = written(shared(left, name))
        some = met if k == size - 1 else met.where(F.col("size") <= block)
        groups.append(some.select(F.col(name).alias("group"), "size", "node"))
        left = met.where(F.col("size") > block).drop("size")
    tiles = F.when(F.col("size") <= block, 1).otherwise(F.ceil(F.col("size") / (block - 1))).alias("tiles")
    met = reduce(DataFrame.unionByName, groups).select("group", "node", tiles)
    leaders = met.where("tiles > 1").groupBy("group", "tiles").agg(F.min("node").alias("node"))
    dealt = met.select("group", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "node").unionByName(
        leaders.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "node")).distinct()
    blocks = (dealt.join(nodes.select("node", "signature"), "node").groupBy("group", "tile")
              .agg(F.collect_list(F.struct("node", "signature")).alias("r")).where(F.size("r") > 1))
    return blocks.select("r.node", "r.signature").mapInArrow(compared, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def whole_sets(docs: DataFrame, nodes: DataFrame, used: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, hashes): the whole sets of the ``used`` nodes, from the first document of each."""
    @F.pandas_udf("node long, hashes binary")
    def whole(texts: pd.Series) -> pd.DataFrame:
        nodes, sets = [np.zeros(0, np.int64)], []
        for some in _slices(texts.tolist()):
            doc, hashes = shingles(some, width)
            nodes.append(node_ids(doc, hashes, len(some)))
            sets += [p.astype("<u8").tobytes() for p in np.split(hashes, np.cumsum(np.bincount(doc, minlength=len(some)))[:-1])]
        return pd.DataFrame({"node": np.concatenate(nodes), "hashes": sets})

    wanted = used.join(nodes, "node").select("node", F.col("first.doc_id").alias("id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(wanted.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    of = found.select(whole(F.col("text")).alias("s")).select("s.*")
    return of.join(used, "node", "left_semi").dropDuplicates(["node"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
                          for x, y in zip(left, right, strict=True)], dtype=bool)

    some = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    narrow, _ = written(some)
    used = narrow.select(F.col("a").alias("node")).union(narrow.select("b")).distinct()
    sets = whole_sets(docs, nodes, used, width)
    own = narrow.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(alike("x", "y")).select("a", "b")


def _nodes(marks: DataFrame) -> DataFrame:
    """One row for every set: node, its first document, fp, signature, keys."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    return marks.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))


def links(docs: DataFrame, nodes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Links (a, b) between nodes that reach the similarity."""
    prints = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    of_prints = (simhash.links_between(prints.select("fp"), RADIUS)
                 .join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
                 .join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    same = nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return verified(docs, nodes, candidates(nodes).unionByName(of_prints).unionByName(same), width)


def _tiles(members: DataFrame) -> DataFrame:
    """Members (group, node, root, bytes, ...) with their tile: (whose, tile), ``whose`` being the one component of its texts.

    Components too large for a tile get tiles of their own, the others of a group share some; null ``whose`` marks these.
    """
    def count(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES), F.lit(1).cast("long"))

    roots = members.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    roots = roots.withColumn("own", count(F.col("n"), F.col("size")))
    small = F.col("own") == 1
    shared = roots.groupBy("group").agg(count(F.sum(F.when(small, F.col("n")).otherwise(0)), F.sum(F.when(small, F.col("size")).otherwise(0))).alias("shared"))
    dealt = members.join(roots.select("group", "root", "own"), ["group", "root"]).join(shared, "group")
    return dealt.select("*", F.when(~small, F.col("root")).alias("whose"),
                        F.when(small, F.pmod(F.xxhash64("root"), F.col("shared"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own"))).alias("tile")).drop("own", "shared")


def missed_links(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Links (a, b) between nodes of different components (``roots``: node, root) that meet in some tree, however large the group.

    A pair is compared in the first tree in which it meets.
    """
    size = len(LEVELS)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(texts: list[dict]) -> tuple:
            return (np.array([t["node"] for t in texts], np.int64), np.array([t["root"] for t in texts], np.int64),
                    np.frombuffer(b"".join(t["signature"] for t in texts), np.uint8).reshape(len(texts), -1),
                    np.array([t["firsts"] for t in texts], np.int64), [np.frombuffer(t["hashes"], "<u8") for t in texts])

        for batch in batches:
            out = []
            for tree, mine, theirs in zip(*batch.columns, strict=True):
                x = arrays(mine.as_py())
                y = arrays(theirs.as_py()) if theirs.is_valid else x
                near = (x[2][:, None, :] == y[2][None, :, :]).mean(axis=2) >= FAR
                here = (x[3][:, None, :] == y[3][None, :, :]).argmax(axis=2) == tree.as_py()
                for a, b in zip(*np.nonzero(near & here & (x[1][:, None] != y[1][None, :])), strict=True):
                    if (theirs.is_valid or a < b) and _alike(x[4][a], y[4][b]):
                        out.append((x[0][a], y[0][b]))
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    firsts = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.get("keys", t * size))
    placed = nodes.select("node", "signature", firsts.alias("firsts")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = placed.select("node", "root", F.posexplode("firsts").alias("tree", "group"))
    mixed = keyed.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("group")
    members, seen = written(keyed.join(mixed, "group"), F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets, _ = written(whole_sets(docs, nodes, members.select("node").distinct(), width))
    dealt, _ = written(_tiles(members.join(sets.select("node", F.length("hashes").alias("bytes")), "node")))
    place = F.struct("whose", "tile")
    tiles = dealt.groupBy("group", "tree", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    pairs = tiles.withColumnRenamed("place", "one").join(tiles.select("group", F.col("place").alias("other")), "group").where(
        (F.col("one") <= F.col("other")) & F.coalesce(F.col("one.whose") != F.col("other.whose"), F.lit(True)))
    held = (dealt.select("group", place.alias("place"), "node").join(placed, "node").join(sets, "node")
            .groupBy("group", "place").agg(F.collect_list(F.struct("node", "root", "signature", "firsts", "hashes")).alias("texts")))
    landed, _ = written(held)
    met = pairs.join(landed.select("group", F.col("place").alias("one"), F.col("texts").alias("mine")), ["group", "one"])
    both = met.join(landed.select("group", F.col("place").alias("other"), F.col("texts").alias("theirs")), ["group", "other"])
    work = both.select(F.col("tree").cast("long").alias("tree"), "mine", F.when(F.col("one") != F.col("other"), F.col("theirs")).alias("theirs"))
    return work.mapInArrow(compared, "a long, b long")


def classes(docs: DataFrame, nodes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, root) of every node that has a link: what the searches connect, and what they left apart though it is linked."""
    found, _ = written(links(docs, nodes, width))
    roots, _ = written(components(found).distinct())
    more, seen = written(missed_links(docs, nodes, roots, width), F.count(F.lit(1)).alias("n"))
    return components(found.unionByName(more)).distinct() if seen["n"] else roots


def one_of_each(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest doc_id."""
    text_batches(docs.sparkSession, BATCH_ROWS)
    marks, _ = written(_marks(docs, width))
    nodes, _ = written(_nodes(marks))
    roots = classes(docs, nodes, width)
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    key = ["__none", "__id", "__node"]
    stays = rooted.groupBy("root").agg(F.min(F.struct("first", "node")).alias("s")).select(
        F.col("s.first.none").alias("__none"), F.coalesce("s.first.doc_id", F.lit(0)).alias("__id"), F.col("s.node").alias("__node"))
    marked = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                               "__node": node_of(F.col("text"), width)})
    return marked.join(stays, key, "left_semi").dropDuplicates(key).select(*docs.columns)
