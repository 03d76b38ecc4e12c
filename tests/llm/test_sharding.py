"""Jump hashing against a plain version, minimal movement, slots, and awkward rows."""

import numpy as np

from auditloom.llm import sharding
from tests.llm.tables import documents, nothing


def plain(key: int, shards: int) -> int:
    state, at, ahead = key % 2**64, -1, 0
    while ahead < shards:
        at = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (2**31 / ((state >> 33) + 1)))
    return at


def test_jump_equals_plain_and_moves_only_to_the_new_shard():
    keys = np.concatenate([np.arange(-50, 3000), [2**63 - 1, -2**63]]).astype(np.int64)
    for shards in (1, 2, 16):
        now, grown = sharding.jump(keys.view(np.uint64), shards), sharding.jump(keys.view(np.uint64), shards + 1)
        assert now.tolist() == [plain(int(k), shards) for k in keys]
        assert set(grown[grown != now]) <= {shards}
        assert abs((grown == shards).mean() - 1 / (shards + 1)) < 0.05


def test_slots_are_gapless_and_rows_whole(spark):
    docs = documents(spark)
    out = sharding.number_slots(sharding.assign_shards(docs, 4), ["doc_id"])
    got = out.select("doc_id", "shard", "slot", "text").collect()
    assert len(got) == docs.count() and out.columns.count("slot") == 1
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.shard == plain(r.doc_id or 0, 4) for r in got)
    assert sharding.number_slots(sharding.assign_shards(nothing(spark), 4), ["doc_id"]).count() == 0


def test_one_key_in_all_rows_and_text_keys(spark):
    same = spark.range(2000).selectExpr("5L AS doc_id", "cast(id as string) AS name")
    slots = sharding.number_slots(sharding.assign_shards(same, 8), ["doc_id"]).select("shard", "slot").collect()
    assert {r.shard for r in slots} == {plain(5, 8)} and sorted(r.slot for r in slots) == list(range(2000))
    assert sharding.assign_shards(same, 8, "name").select("shard").distinct().count() == 8


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.where("shard < 0 or shard > 3").count() == 0
