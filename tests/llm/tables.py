"""Small tables with the awkward cases every operator must take, and plain-Python measures of texts."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    """Prose, copies, near copies, shared passages, repeats, odd white space, nulls and a long text."""
    rng = random.Random(seed)
    shared = prose(rng, 40)
    out = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 12, 30, 90, 200]))
        kind = i % 8
        if kind == 1:
            text = out[rng.randrange(len(out))][1] or text
        elif kind == 2:
            text = f"{text} {shared} {prose(rng, 5)}"
        elif kind == 3:
            text = "\n".join([text, "same line", text, "same line", ""])
        elif kind == 4:
            text = f"É {text.upper()}\t\x0b {text} end ß | * 100%  \n\n"
        elif kind == 5 and i > 8:
            parts = (out[i - 1][1] or "x").split(" ")
            text = " ".join(p + "q" if k == len(parts) // 2 else p for k, p in enumerate(parts))
        out.append((i * 3 - 20, text, ["en", "de", None][i % 3], f"s{min(i % 5, 2)}" if i % 11 else None, len(text)))
    out += [(1000, None, "en", "s0", None), (1001, "", "en", "s0", 0), (1002, " \n\t ", None, None, None),
            (1003, prose(rng, 30_000), "en", "s1", None), (None, out[2][1], "en", "s2", None), (None, None, None, None, None)]
    return out + [out[3], out[3], (out[4][0], "another text of the same id", "en", "s0", None)]


def documents(spark: SparkSession, given: list[tuple] | None = None) -> DataFrame:
    """The rows with extra columns that are named like results and like this library's own columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if given is None else given, SCHEMA)
    names = ["shard", "slot", "size", "key", "block", "spans", "kept", "fp", "component_id", "chunk", "bucket", "m", "stratum",
             "sequence_id", "offset", "ids", "before", "license", "notices", "score", "root", "cut"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def nothing(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
