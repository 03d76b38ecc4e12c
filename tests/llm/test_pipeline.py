"""Each stage against brute force on what its predecessor kept; the whole on awkward tables."""

import os

import pytest

import corpus_pipeline
from tests.llm.tables import SCHEMA, rows, words
from tests.llm.test_quality import plain as measured
from tests.llm.test_resemblance import stays

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out["given"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        docs = out[name] = spark.read.parquet(str(root / name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]


def test_columns_stay(stages):
    for name in ("quality", "near_duplicates", "secrets", "mixing"):
        assert stages[name].dtypes == stages["given"].dtypes


def test_quality_keeps_clean_documents(stages):
    before, after = texts(stages["given"]), texts(stages["quality"])
    for d, t in before.items():
        m = measured(t)
        failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        clean = not (m["n_symbols"] or m["n_dup_lines"] or m["n_repeat_words"]) and m["n_capitals"] < 0.3 * m["word_chars"]
        assert not (failed and d in after) and (d in after or failed or not clean)
        assert d not in after or after[d] == t


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages["quality"]), texts(stages["near_duplicates"])
    assert sorted(after) == [d for _, d in stays([(d, t) for d, t in before.items()])]
    assert all(before[d] == t for d, t in after.items())


def test_secrets_are_masked_and_all_else_stays(stages):
    from auditloom.llm.secrets_scan import GuessCost, all_spans

    before, after = texts(stages["near_duplicates"]), texts(stages["secrets"])
    assert set(before) == set(after)
    for d, t in before.items():
        assert not all_spans(after[d], GuessCost(), 8, 8)
        assert (t == after[d]) == (not all_spans(t, GuessCost(), 8, 8))
    assert all(r.n_chars == len(r.text) for r in stages["secrets"].collect())


def test_mix_and_packing_hold_all_documents(stages):
    assert texts(stages["mixing"]) == texts(stages["secrets"])
    pieces = stages["packing"].collect()
    assert {r.doc_id for r in pieces} == set(texts(stages["mixing"]))
    assert all(sum(p.length for p in pieces if p.doc_id == d) == next(p.doc_tokens for p in pieces if p.doc_id == d)
               for d in list(texts(stages["mixing"]))[:20])


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    for name, given in (("odd", rows()), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(given, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        kept = {d for d, t, *_ in given if len(words(t)) >= 20}
        assert {r.doc_id for r in got} <= kept and bool(got) == bool(given)
