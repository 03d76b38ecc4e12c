"""Licence scan: canonical digests of whole texts and whole lines, joined to known licences.

Two texts have the same canonical form when they differ only in case, punctuation and spacing,
copyright lines, and spellings that mean the same. Its SHA-256 is looked up by a hash join in the
digests of the known licences, so nothing but an entire text, or an entire line as a notice, counts.

Defined cases: a null text is an empty one and matches nothing; rows that repeat a document are reported
each; rows of the known table without id or text are ignored; of known ids with one digest the
first counts; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.words import text_batches

# What the canonical form removes and which spellings it unites.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")
# A notice names a sign, a year, 'by' or a blank to fill in; 'copyright holders' and list items '(c)' are text.
COPYRIGHT_LINE = re.compile(r"(^|\n)[ \t]*(copyright[ \t:,]*(\(c\)|©|[0-9]{4}|by[ \t]|[<\[{])"
                            r"|\(c\)[ \t]*(copyright|[0-9]{4}|by[ \t]|[<\[{])|©|all rights reserved)[^\n]*")
ASCII_PUNCTUATION = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
OTHER_PUNCTUATION = dict.fromkeys(map(ord, "“”‘’–—…©"), " ")
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
             ("organisation", "organization"), ("non commercial", "noncommercial"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"), ("fulfil ", "fulfill "), ("analyse", "analyze")]

# Notices and short licences in common use.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC": ["""ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
}


def canonical(text: str) -> bytes:
    """The canonical form as UTF-8."""
    plain = text.lower()
    if any(mark in plain for mark in COPYRIGHT_MARKS):
        plain = COPYRIGHT_LINE.sub("\n", plain)
    if not plain.isascii():
        plain = plain.translate(OTHER_PUNCTUATION)
    plain = b" ".join([b"", *plain.encode().translate(ASCII_PUNCTUATION).split(), b""])
    for one, other in SPELLINGS:
        plain = plain.replace(one.encode(), other.encode())
    return plain.strip(b" ")


def _digest(text: str) -> bytes | None:
    plain = canonical(text)
    return hashlib.sha256(plain).digest() if plain else None


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where nothing is left."""
    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([_digest(t) for t in texts], dtype=object)

    return digests(F.coalesce(text, F.lit("")))


def line_digests(text: Column) -> Column:
    """The digests of a text's lines, those without any left out."""
    @F.pandas_udf("array<binary>")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([[d for d in map(_digest, t.split("\n")) if d] for t in texts], dtype=object)

    return digests(F.coalesce(text, F.lit("")))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the built-in list; any table of this shape will do."""
    return spark.createDataFrame([(k, t) for k, texts in KNOWN.items() for t in texts], "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license (of the whole text), notices and notice_lines of every row.

    ``known`` is joined by Spark's own choice of join, so it may have any size. Lines are cut to those with a
    known digest before they are gathered by document, and then to one row per document.
    """
    text_batches(docs.sparkSession)
    ids = (known.where("license is not null").select(digest(F.col("text")).alias("text_digest"), "license")
           .where("text_digest is not null").groupBy("text_digest").agg(F.min("license").alias("license")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    lines = rows.select("doc_id", "th", F.explode(line_digests(F.col("text"))).alias("text_digest"))
    found = lines.join(ids, "text_digest")
    of_line = found.groupBy("doc_id", "th", "license").agg(F.count(F.lit(1)).alias("n"))
    notices = of_line.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.sum("n").alias("n"))
    # Rows that repeat a document exactly add their lines up; each gets its own share.
    repeats = rows.groupBy(F.col("doc_id").alias("id2"), F.col("th").alias("h2")).agg(F.count(F.lit(1)).alias("times"))
    share = notices.join(repeats, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).select(
        "id", "h", "notices", (F.col("n") / F.col("times")).cast("long").alias("n"))
    whole = rows.select("doc_id", "th", digest(F.col("text")).alias("text_digest")).join(ids, "text_digest", "left")
    met = whole.join(share, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left")
    return met.select("doc_id", F.lower(F.hex("text_digest")).alias("text_digest"), "license", F.coalesce("notices", F.lit("")).alias("notices"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("notice_lines"))
