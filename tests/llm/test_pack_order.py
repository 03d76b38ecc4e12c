"""Sequences follow the order in which the mix was written, also over files of unequal size."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.tables import SCHEMA, prose

SHARES = {"a": 3, "b": 2, "c": 1}


def test_prefix_shares_by_source_over_several_files(spark, tmp_path):
    """Files grow, so a reader that takes the largest first begins with the last, which holds one source only."""
    rng, given, file_of = random.Random(2), [], []
    for part in range(8):
        for k in range(60 + 30 * part):
            source = [s for s, n in SHARES.items() for _ in range(n)][k % 6] if part < 7 else "c"
            given.append((len(given), prose(rng, 300), "en", source, 1))
            file_of.append(part)
    docs = spark.createDataFrame([(*g, f) for g, f in zip(given, file_of, strict=True)], SCHEMA + ", f int")
    for part in range(8):
        (docs.where(F.col("f") == part).drop("f").coalesce(1).sortWithinPartitions("doc_id").write.mode("append")
         .parquet(str(tmp_path / f"p{part}")))
    folder = tmp_path / "mix"
    folder.mkdir()
    for part in range(8):
        (found,) = (tmp_path / f"p{part}").glob("part-*.parquet")
        (folder / f"part-{part:05d}-x.c000.snappy.parquet").write_bytes(found.read_bytes())
    mix = spark.read.parquet(str(folder))
    order = [r.doc_id for r in corpus_pipeline.written_order(mix).collect()]
    assert order == list(range(len(given)))
    source = {d: s for d, _, _, s, _ in given}
    pieces = corpus_pipeline.packed(spark, mix, "").orderBy("sequence_id", "offset").collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    tokens, mixed = Counter(), sum(p.length for p in pieces if file_of[p.doc_id] < 7)
    for p in pieces:
        tokens[source[p.doc_id]] += p.length
        done = sum(tokens.values())
        if mixed / 3 < done < 0.9 * mixed:
            for s, n in SHARES.items():
                assert abs(tokens[s] - done * n / 6) < 64 * 2048


def test_rows_of_no_file_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], SCHEMA)
    assert corpus_pipeline.packed(spark, docs, "").count() == 1
