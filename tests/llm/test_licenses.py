"""Canonical forms, whole texts and lines against plain Python."""

import hashlib
import re

from auditloom.llm import licenses
from tests.llm.tables import documents, nothing


def plain(text):
    t = re.sub(licenses.COPYRIGHT_LINE, "\n", (text or "").lower())
    t = " " + re.sub(r"[\x00-/:-@\[-`{-\x7F“”‘’–—…©]+", " ", t) + " "
    for a, b in licenses.SPELLINGS:
        t = t.replace(a, b)
    t = t.strip(" ")
    return hashlib.sha256(t.encode()).hexdigest() if t else None


MIT = licenses.KNOWN["MIT"][2]
OTHER = re.sub("  +", " ", MIT.replace('"Software"', "“Software”").replace("MIT License", "M.I.T. LICENSE").upper().replace("\n", "  \n"))
TEXTS = [MIT, f"Copyright (c) 2020 A. B.\n\n{MIT.upper()}", MIT + " and more", "prose\nReleased under the MIT licence\nprose\nLICENSED under CC BY-NC 4.0",
         "licensed under the apache licence - version 2.0!", "Licensed under CC BY-NC 4.0. too", None, "", "...", "É ﬁ Ⅷ", OTHER]


def test_rows_equal_plain(spark):
    known = licenses.known_licenses(spark)
    ids = {}
    for name, texts in licenses.KNOWN.items():
        for t in texts:
            ids[plain(t)] = min(name, ids.get(plain(t), name))
    given = [(k, t, "en", "s", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1), (3, "other", "en", "s", 1), (None, TEXTS[4], None, None, None)]
    got = licenses.license_scan(documents(spark, given), known).collect()
    want = []
    for doc_id, text, *_ in given:
        lines = [ids[plain(line)] for line in (text or "").split("\n") if plain(line) in ids]
        want.append((doc_id, plain(text), ids.get(plain(text)), ",".join(sorted(set(lines))), len(lines)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].license == by_id[1].license == "MIT" and by_id[2].license is None
    assert {r.notices for r in got if r.doc_id == 3} == {"CC-BY-NC-4.0,MIT", ""}
    assert by_id[5].notice_lines == 0


def test_no_rows(spark):
    assert licenses.license_scan(nothing(spark), licenses.known_licenses(spark)).collect() == []
    empty = spark.createDataFrame([], "license string, text string")
    assert licenses.license_scan(documents(spark), empty).where("license is not null").count() == 0
