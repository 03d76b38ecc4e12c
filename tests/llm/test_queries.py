"""The registered queries: SQL where there is some, contracts of the others on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from auditloom.llm.oracles import SQL
from auditloom.llm.queries import QUERIES
from tests.llm.test_packing import encoded
from tests.llm.test_secrets import ASSIGN
from tests.llm.test_simhash import groups, plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, db, name):
    frame = QUERIES[name](spark, SF)
    cursor = db.execute(SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(d[0] for d in cursor.description)
    place = [next(k for k, d in enumerate(cursor.description) if d[0] == c) for c in columns]
    want = sorted(tuple(str(r[k]) for k in place) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == want


def test_secret_digests(spark, texts):
    import re

    got = QUERIES["op2_secret_spans"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_fingerprints_and_components(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, SF).collect()}
    prints = {d: plain(t) for d, t in texts.items()}
    of, least = groups(list(prints.values())), {}
    for d in sorted(prints):
        least.setdefault(of[prints[d]], d)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {
        d: (f"{p:016x}", least[of[p]]) for d, p in prints.items()}


def test_packed_pieces(spark, texts):
    pieces, sequences = {}, {}
    for r in QUERIES["op8_pack"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (d, _), ids in zip(texts.items(), encoded(list(texts.values())), strict=True):
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, zlib.crc32(part), r.doc_tokens) == (at, r.ids_crc32, len(ids))
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_schedule_and_scores_cover_all_documents(spark, texts):
    mixed = QUERIES["op3_pfair_mix"](spark, SF).collect()
    scored = QUERIES["op10_maxent"](spark, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in scored) == sorted(texts)
    assert {r.doc_id for r in scored if r.held_out} == {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    assert np.mean([r.score - r.base_score for r in scored if r.held_out]) > 0
