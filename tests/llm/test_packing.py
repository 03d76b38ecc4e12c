"""Exact round trip of all ids, gapless windows, little padding, any number of partitions."""

from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from auditloom.llm import packing  # noqa: E402
from tests.llm.tables import documents, nothing, rows  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["It's 5.5%, É.È, don't! <|endoftext|> a<|startoftext|>b", "ﬁn Ⅷ İstanbul ΑΣ. Σ, é.  x y\x1cz", "ß. ẞ, Ñandú.. ,. . a.b, A.B.",
       "́x. á, Å. 東京。 ١٢ 🎉. zero​width", "x" * 300 + ". " + "Y" * 70 + ","]


def test_words_give_the_ids_of_the_text():
    tokenizer = packing.WordTokenizer(PATH)
    texts = ODD + [r[1] or "" for r in rows()]
    for _ in range(2):  # with an empty and a filled cache
        assert [ids.tolist() + [1] for ids in tokenizer.encode(texts)] == encoded(texts)


@pytest.mark.parametrize(("partitions", "windows", "size"), [(1, 4, 64), (5, 2, 100), (40, 64, 2048)])
def test_round_trip(spark, partitions, windows, size):
    docs = documents(spark).repartition(partitions)
    got = packing.pack(docs, PATH, size=size, windows=windows).collect()
    texts = defaultdict(list)
    for doc_id, text, *_ in rows():
        texts[doc_id].append(text)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in texts.items():
        if len(own) == 1:
            parts = sorted(pieces[doc_id])
            assert [i for _, ids, _ in parts for i in ids] == encoded(own)[0]
            assert [s for s, _, _ in parts] == list(np.cumsum([0] + [len(ids) for _, ids, _ in parts])[:-1])
            assert {n for _, _, n in parts} == {len(encoded(own)[0])}
        else:
            assert sum(len(ids) for _, ids, _ in pieces[doc_id]) == sum(map(len, encoded(own)))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1]) and sum(n for _, n in spans) <= size
    assert packing.pack(nothing(spark), PATH).count() == 0


def test_little_padding_from_many_partitions(spark):
    docs = spark.range(0, 4000, 1, 20).selectExpr("id AS doc_id", "repeat('word ', cast(3 + id * 7919 % 300 as int)) AS text")
    got = packing.pack(docs, PATH, size=512, windows=32).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in got]
    assert 1 - sum(used) / (512 * len(used)) < 0.02


def test_a_full_cache_only_costs_time(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    tokenizer = packing.WordTokenizer(PATH)
    texts = [r[1] or "" for r in rows()][:20]
    for text in texts:
        assert tokenizer.encode([text])[0].tolist() + [1] == encoded([text])[0]
