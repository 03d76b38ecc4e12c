"""Verbatim licence files in several line widths; notices go and all other lines stay."""

import textwrap

import pytest

from auditloom.llm import licenses
from tests.llm.tables import documents

BODIES = {name: " ".join(texts[-1].split("\n")[1:]) for name, texts in licenses.KNOWN.items() if name in ("MIT", "ISC")}


@pytest.mark.parametrize("name", ["MIT", "ISC"])
def test_whole_files_are_known_at_any_width(spark, name):
    files = [f"{name} License\n\nCopyright (c) 2021 A. B.\n\n{textwrap.fill(BODIES[name], w)}\n" for w in (40, 60, 70, 72, 79, 80, 100, 120)]
    files.append(f"{name} License\nCopyright 2019-2020 by A. B.\nAll rights reserved.\n{BODIES[name]}")
    files.append(f"{name} License\n" + BODIES[name].replace(" COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE").replace(" copyright notice", "\ncopyright notice"))
    given = [(k, t, "en", "s", 1) for k, t in enumerate(files)]
    got = licenses.license_scan(documents(spark, given), licenses.known_licenses(spark)).collect()
    assert [r.license for r in got] == [name] * len(files) and len({r.text_digest for r in got}) == 1


def test_clauses_stay_and_notices_go():
    for line in ("COPYRIGHT HOLDERS BE LIABLE", "copyright notice and this", "copyright owner or entity", "(c) You must retain"):
        assert licenses.canonical(f"a\n{line}\nb").count(b" ") > 2
    for line in ("Copyright (c) 2020 X", "COPYRIGHT © X", "copyright 1999, X", "Copyright by X", "(c) 2020 X", "© X", "Copyright [yyyy] [name]"):
        assert licenses.canonical(f"a\n{line}\nb") == b"a b"
