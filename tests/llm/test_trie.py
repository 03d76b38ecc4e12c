"""The prefix trie against a plain one, with shards of few conversations and short stretches."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from auditloom.llm import trie
from tests.llm.tables import words

SCHEMA = "conv_id long, turn long, role string, text string"


def given(seed=3):
    """Shared beginnings, copies, gaps in the ids, nulls, equal turn numbers, repeated rows, one long conversation."""
    rng, out = random.Random(seed), []
    openings = [[("user", f"hello {k}"), ("assistant", "good day to you"), ("user", "x y  z")] for k in range(3)]
    for c in rng.sample(range(130), 70):
        talk = list(rng.choice(openings))[:rng.randint(0, 3)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, " ", "ä ö\n ü"]))
                                                                for _ in range(rng.randint(0, 4))]
        numbers = [None if rng.random() < 0.1 else k for k in range(len(talk))]
        out += [(c, n, role, text) for n, (role, text) in zip(numbers, talk, strict=True)]
    out += [(200, k, "user", f"turn {k % 5}") for k in range(40)] + [(207, k, "user", f"turn {k % 5}") for k in range(38)]
    out += [(300, 1, "user", "one"), (321, 0, "user", "gone"), (322, 0, "user", "gone"), (None, 0, "user", "no id"), (None, None, None, None)]
    return out + [out[0], out[0], (out[1][0], out[1][1], "user", "another of the same number")]


def plain(rows, family=20):
    """{path: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    talks = {c: own.get(c - c % family, [])[:h[c]] + own[c][h[c]:] for c in own}
    nodes = {}
    for c, talk in talks.items():
        for d in range(len(talk) + 1):
            nodes.setdefault(tuple(talk[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, convs in nodes.items():
        cost = (len(convs) - 1) * len(words(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += cost
    return sorted((min(convs), len(p), min(nodes[p[:-1]]) if p else None, len(convs), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(p)).encode()).hexdigest())
                  for p, convs in nodes.items())


@pytest.mark.parametrize("shard, stretch", [(1024, 512), (3, 2), (1, 3), (40, 7)])
def test_equals_a_plain_trie(spark, shard, stretch):
    rows = given()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("node", "pos", "n", "least", "words", "last", "start")})
    got = sorted(tuple(r) for r in trie.prefix_trie(table, shard=shard, stretch=stretch).collect())
    assert got == plain(rows)


def test_end_lists_longer_than_a_row(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 20)] + [(c, 0, "user", "other") for c in range(1, 400, 40)]
    assert sorted(tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_nodes_are_merged_from_bounded_shards(spark):
    """All conversations share their first turn: no shard holds more than its share of them."""
    rows = [(c, d, "user", "all" if d == 0 else f"{c}") for c in range(0, 4000, 20) for d in (0, 1)]
    shards = trie.sharded(trie.rebuilt(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))), conversations=20)
    most = shards.groupBy("shard", "stretch").agg(F.count_distinct("conv_id").alias("n")).agg(F.max("n")).first()[0]
    assert most < 60
