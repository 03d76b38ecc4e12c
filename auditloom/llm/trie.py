"""Prefix trie of conversations, built from vertical bitmaps.

A shard holds some conversations and a stretch of their positions. It indexes (position, turn) to a bitset of
its conversations. A depth-first walk intersects the bitset of a node with the postings of the next position:
every non-empty intersection is a child; its population count is the number of members, its lowest bit the
smallest conversation, and the members whose last turn it is are the end list. Shards are of bounded size,
so a first turn, a copied conversation or one conversation of any length is spread over many of them.

A node is known in all shards by its path: 128 bits, four sums modulo 2**32 of the digests of (position, turn)
on the way to it. Sums let a shard begin in the middle of a conversation. Nodes of several shards are merged by
path, with counts added before they move.

What a subtree holds is summed without walking the merged trie. A node belongs to its smallest member; the
nodes that belong to a conversation are the lower end of its path. So the sum over the subtree of a node
is the sum, over its members, of all that belongs to them, less what belongs to the smallest member above
the node. The first is a second walk of the shards with one number per conversation, the second a running total.

Defined cases: null roles and texts are empty; turns with equal numbers are ordered by a digest of role and
text, null numbers first; turns without a conv_id take no part; repeated rows are turns of their own; a
conversation that keeps no turn is a member of the root; no conversations give no rows, not even a root;
texts of any length are hashed where they are read and not moved; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.prefix import running_totals
from auditloom.session import written

FAMILY, HEADS = 20, 4
CONVERSATIONS, POSITIONS = 1024, 512  # of a shard
LISTED = 4096  # ids joined in one row
WORD = r"[^ \t\n\x0B\f\r]+"
LIMBS = ["l0", "l1", "l2", "l3"]
ROOT = "0" * 32


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn digest and number of words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    digests, _ = written(rows)  # texts are read once, not again to find the ranges
    placed = running_totals(digests, ["conv_id"], ["turn", "digest"], F.lit(1), "before")
    return placed.select("conv_id", (F.col("before") + 1).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, pos, digest, words, last: position 0 stands for the conversation itself, ``last`` for its length.

    The first h turns come from the first conversation of the family, the others are the conversation's own.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    kept = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    known = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last"))
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "base")
    taken = known.join(first, "base").where("place <= h").select("conv_id", F.col("place").alias("pos"), "digest", "words", "last")
    own = turns.join(known, "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("kept")).alias("pos"), "digest", "words", "last")
    itself = known.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"), "last")
    return itself.unionByName(taken).unionByName(own)


def _limb(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def sharded(rows: DataFrame, family: int = FAMILY, conversations: int = CONVERSATIONS, positions: int = POSITIONS) -> DataFrame:
    """Rows of ``rebuilt`` dealt to shards; ``start`` rows hold the path of a conversation before the shard's stretch."""
    if positions < 2:
        raise ValueError("a stretch has two positions or more: its start must not be taken for the root")
    n = rows.where("pos = 0").count()
    shards = max(1, -(-n // conversations))
    path = F.md5(F.concat_ws(":", "pos", "digest"))
    hashed = rows.withColumn("path", path).select(
        "conv_id", "pos", "words", "last", (F.col("pos") == 0).alias("start"),
        *[F.when(F.col("pos") == 0, 0).otherwise(_limb(F.col("path"), k)).cast("long").alias(c) for k, c in enumerate(LIMBS)],
        F.floor(F.col("pos") / positions).alias("stretch"))
    held, _ = written(hashed)
    long = held.where(F.col("last") >= positions)
    sums = long.groupBy("conv_id", "stretch").agg(F.max("last").alias("last"), *[F.sum(c).alias(c) for c in LIMBS])
    so_far = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for some hundred turns
    before = sums.select("conv_id", "stretch", "last", *[F.sum(c).over(so_far).alias(f"b{k}") for k, c in enumerate(LIMBS)])
    starts = before.where("stretch > 0").select(
        "conv_id", (F.col("stretch") * positions - 1).alias("pos"), F.lit(0).cast("long").alias("words"), "last", F.lit(True).alias("start"),
        *[(F.col(f"b{k}") % (1 << 32)).alias(c) for k, c in enumerate(LIMBS)], "stretch")
    base = F.col("conv_id") - F.col("conv_id") % family
    return held.unionByName(starts).withColumn("shard", F.pmod(F.xxhash64(base), F.lit(shards)))


class Bitmaps:
    """Postings of one shard: bitsets as whole numbers, bit i for the i-th smallest conversation."""

    def __init__(self, table: pa.Table):
        columns = {name: table.column(name).to_pylist() for name in ("conv_id", "pos", "start", *LIMBS, "words", "last")}
        self.ids = sorted(set(columns["conv_id"]))
        place = {c: k for k, c in enumerate(self.ids)}
        self.starts: dict[tuple, int] = defaultdict(int)
        self.postings: dict[tuple, int] = defaultdict(int)
        self.present: dict[int, int] = defaultdict(int)
        self.last: dict[int, int] = defaultdict(int)
        self.turn: dict[tuple[int, int], tuple] = {}
        self.words: dict[tuple, int] = {}
        limbs = zip(*[columns[c] for c in LIMBS], strict=True)
        for c, pos, start, turn, words, last in zip(columns["conv_id"], columns["pos"], columns["start"], limbs, columns["words"], columns["last"], strict=True):
            k = place[c]
            if start:
                self.starts[pos, turn] |= 1 << k
                self.last[last] |= 1 << k
            else:
                self.postings[pos, turn] |= 1 << k
                self.present[pos] |= 1 << k
                self.turn[k, pos] = turn
                self.words[pos, turn] = words

    def nodes(self) -> Iterator[tuple[str, int, str | None, int, int]]:
        """(path, depth, parent's path, members, words) of every node, depth first."""
        waiting = [(pos, path, bits) for (pos, path), bits in self.starts.items()]
        for pos, path, bits in waiting:
            if pos == 0:
                yield ROOT, 0, None, bits, 0
        while waiting:
            pos, path, bits = waiting.pop()
            rest, name = bits & self.present.get(pos + 1, 0), None
            while rest:
                turn = self.turn[(rest & -rest).bit_length() - 1, pos + 1]
                child = rest & self.postings[pos + 1, turn]
                rest ^= child
                name = name or _name(path)
                below = tuple((a + b) % (1 << 32) for a, b in zip(path, turn, strict=True))
                yield _name(below), pos + 1, name, child, self.words[pos + 1, turn]
                waiting.append((pos + 1, below, child))

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield self.ids[low.bit_length() - 1]
            bits ^= low


def _name(path: tuple) -> str:
    return "%08x%08x%08x%08x" % path


def _walked(shards: DataFrame, columns: str, make: Callable) -> DataFrame:
    """The columns of ``make(table, bitmaps)``, a list of rows, of every shard."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

    def walk(table: pa.Table) -> pa.Table:
        rows = make(table, Bitmaps(table))
        values = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.table([pa.array(v, schema.field(k).type) for k, v in enumerate(values)], schema=schema)

    return shards.groupBy("shard", "stretch").applyInArrow(walk, columns)


def merged_nodes(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all shards by path, and (node, conv_id) of the conversations that end there."""
    def found(table: pa.Table, maps: Bitmaps) -> list[tuple]:
        return [(node, depth, parent, bits.bit_count(), maps.ids[(bits & -bits).bit_length() - 1], words,
                 list(maps.members(bits & maps.last.get(depth, 0)))) for node, depth, parent, bits, words in maps.nodes()]

    parts, _ = written(_walked(shards, "node string, depth long, parent string, n long, least long, words long, ends array<long>", found))
    nodes = parts.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n").alias("n"),
                                      F.min("least").alias("least"), F.max("words").alias("words"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    whole, _ = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    return whole, parts.select("node", F.explode("ends").alias("conv_id"))


def subtree_sums(shards: DataFrame, owned: DataFrame) -> DataFrame:
    """(node, total, leaves): ``owned`` (conv_id, total, leaves) summed over the members of every node."""
    def found(table: pa.Table, maps: Bitmaps) -> list[tuple]:
        total, leaves = defaultdict(int), defaultdict(int)
        for c, start, t, leaf in zip(*[table.column(k).to_pylist() for k in ("conv_id", "start", "total", "leaves")], strict=True):
            if start:
                total[c], leaves[c] = t, leaf
        out = []
        for node, _, _, bits, _ in maps.nodes():
            ids = list(maps.members(bits))
            out.append((node, sum(total[c] for c in ids), sum(leaves[c] for c in ids)))
        return out

    zero = F.lit(0).cast("long")
    starts = shards.where("start").join(owned, "conv_id", "left").withColumns(
        {"total": F.coalesce("total", zero), "leaves": F.coalesce("leaves", zero)})
    turns = shards.where("NOT start").withColumns({"total": zero, "leaves": zero})
    parts = _walked(starts.unionByName(turns), "node string, total long, leaves long", found)
    return parts.groupBy("node").agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves"))


def list_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): the ids in order, comma-joined.

    Ids are joined in ranges, some thousands a row; one task then hashes the rows of a node as they come.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids, out, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for k in range(1, len(nodes) + 1):
                if k == len(nodes) or nodes[k] != nodes[start] or k - start == LISTED:
                    out.append((nodes[start], ids[start], ",".join(map(str, ids[start:k]))))
                    start = k
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array([r[2] for r in out], pa.string())], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = ranged.mapInArrow(joined, "node string, first long, ids string")
    dealt = parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return dealt.mapInArrow(hashed, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, shard: int = CONVERSATIONS,
                stretch: int = POSITIONS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    turns, _ = written(numbered_turns(conversations))
    shards, _ = written(sharded(rebuilt(turns, family, heads), family, shard, stretch))
    nodes, ends = merged_nodes(shards)
    cost = (F.col("n") - 1) * F.col("words")
    owned = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.sum(cost).alias("total"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = subtree_sums(shards, owned)
    placed = running_totals(nodes, ["least"], ["depth"], cost, "above")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    rows = (placed.join(sums, "node").join(list_digests(ends), "node", "left").join(parents, "parent", "left"))
    none = F.sha2(F.lit(""), 256)
    return rows.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                       F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("above")).alias("saved_tokens"),
                       F.coalesce("ends_sha256", none).alias("ends_sha256"))
