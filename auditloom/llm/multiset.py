"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is a line of the text, blank or not. Its vector has 81 lanes, each a whole number modulo 2**32:

- the number of its blocks (four words from its first word on, with the white space between them, and so on;
  the last block may be shorter);
- 16 lanes cut from two salted SHA-256 digests of the paragraph;
- 64 lanes that count, for each of the first 64 bits of MD5, the blocks in whose digest the bit is set.

A text's fingerprint is the sum of its paragraphs' vectors. So the order of paragraphs does not matter, a
paragraph is inserted or deleted by adding or subtracting its vector (``plus``, ``minus``), and two texts have
equal fingerprints if and, but for collisions of 512 bits, only if they have the same paragraphs equally often.

Twice a bit lane less the count is a sum of random signs over the blocks. The difference of two such
vectors is the same sum over the blocks the texts do not share, and its squared length estimates how many
these are. ``likeness`` is one less that share of all blocks, cut off at 0: 1 for equal fingerprints, about 0 for
texts with nothing in common; with 64 lanes the estimate errs by about a sixth of the part not shared.

All of it are built-in functions. Sums are taken row by row of exploded blocks, so a text of any length needs
no more memory than itself; a sum stays below 2**31, the longest text Spark holds, and cannot overflow.

Defined cases: null texts count as empty, and the empty text is one empty paragraph; rows that repeat an id
and a text follow each other, so all but the last of them have their own text next; rows of one id are
ordered by the SHA-256 of their texts; null ids come last; an only row is its own next; an empty
table gives an empty result; other columns are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.prefix import running_totals
from auditloom.llm.words import SPACES, let
from auditloom.session import written

WIDE, BITS, BLOCK = 16, 64, 4
MODULUS = 1 << 32
PAIR = (1 << 32) + 1  # one bit of each half of a long
KEY = ["none", "id", "mark"]
WORD = r"[^ \t\n\x0B\f\r]+"


def _digits(digest: Column, at: int, n: int) -> Column:
    """``n`` hexadecimal digits from place ``at`` as a long; sixteen give the signed one."""
    return F.conv(F.substring(digest, at + 1, n), 16, -10).cast("long")


def _blocks(paragraph: Column) -> Column:
    """The words of a paragraph, some at a time; none if it is blank."""
    return F.regexp_extract_all(paragraph, F.lit(f"{WORD}(?:{SPACES}{WORD}){{0,{BLOCK - 1}}}"), F.lit(0))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``print``, the lanes of the text; rows with equal keys are summed as one text.

    If ``texts`` already is dealt by (some of) the keys, nothing is shuffled.
    """
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("__p"))
    parts = paragraphs.select(*keys, F.sha2(F.concat(F.lit("0:"), "__p"), 256).alias("__d0"),
                              F.sha2(F.concat(F.lit("1:"), "__p"), 256).alias("__d1"),
                              F.posexplode_outer(_blocks(F.col("__p"))).alias("__k", "__s"))
    digests = parts.select(*keys, "__d0", "__d1", F.coalesce("__k", F.lit(0)).alias("__k"), F.md5("__s").alias("__h"))
    halves = digests.select(*keys, "__d0", "__d1", "__k", F.col("__h").isNotNull().cast("long").alias("__one"),
                            _digits(F.col("__h"), 0, 16).alias("__bits"))
    half = WIDE // 2
    wide = [F.sum(F.when(F.col("__k") == 0, _digits(F.col(f"__d{k // half}"), 8 * (k % half), 8))) for k in range(WIDE)]
    pairs = [F.sum(F.shiftrightunsigned("__bits", s).bitwiseAND(F.lit(PAIR))) for s in range(BITS // 2)]
    sums = halves.groupBy(*keys).agg(F.sum("__one").alias("__n"), *[s.alias(f"__w{k}") for k, s in enumerate(wide)],
                                     *[F.coalesce(s, F.lit(0)).alias(f"__b{k}") for k, s in enumerate(pairs)])
    of = [F.col(f"__b{s}") for s in range(BITS // 2)]
    bits = [p.bitwiseAND(F.lit(MODULUS - 1)) for p in of] + [F.shiftrightunsigned(p, 32) for p in of]
    lanes = F.array(F.col("__n"), *[F.pmod(f"__w{k}", F.lit(MODULUS)) for k in range(WIDE)], *bits)
    return sums.select(*keys, lanes.alias("print"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def in_hex(lanes: Column) -> Column:
    """Eight lowercase digits for every lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, by the fingerprints alone."""
    def signs(lanes: Column) -> Column:
        return let(lanes, lambda v: F.transform(F.slice(v, WIDE + 2, BITS), lambda x: (2 * x - F.get(v, 0)).cast("double")))

    def length(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        apart = F.zip_with(x, y, lambda s, t: s - t)
        return F.try_divide(length(apart), length(x) + length(y))

    most = F.lit(1.0) - let(F.struct(signs(a).alias("x"), signs(b).alias("y")), share)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.coalesce(most, F.lit(0.0)), F.lit(0.0)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                       F.unhex(F.sha2(text, 256)).alias("mark"), text.alias("text"))


def _next_rows(rows: DataFrame) -> DataFrame:
    """KEY, n_chars, then the key of the next row, and how many of the equal rows it follows (``times``)."""
    narrow = rows.groupBy(*KEY).agg(F.first(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranked, seen = written(running_totals(narrow.withColumn("all", F.lit(0)), ["all"], KEY, F.lit(1), "rank"),
                           F.count(F.lit(1)).alias("n"))
    total = F.lit(max(seen["n"], 1))
    after = ranked.select(F.pmod(F.col("rank") - 1, total).alias("rank"), *[F.col(k).alias(f"next_{k}") for k in KEY])
    other = F.struct(*[F.col(f"next_{k}") for k in KEY], F.lit(1).cast("long").alias("times"))
    itself = F.struct(*[F.col(k).alias(f"next_{k}") for k in KEY], (F.col("copies") - 1).alias("times"))
    ways = F.filter(F.array(other, itself), lambda w: w["times"] > 0)
    return ranked.join(after, "rank").select(*KEY, "n_chars", F.inline(ways))


def compare_next(docs: DataFrame) -> DataFrame:
    """Of every row its fingerprint, that of its edited text, and the likenesses to that and to the next row.

    The edited text has its last quarter replaced by the beginning of the next row's text. Its fingerprint is
    the text's, less the paragraphs from the cut on, plus those that come there. Texts move once; of the next
    text only the part that is wanted moves again.
    """
    rows = _keyed(docs)
    whole = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    own = fingerprints(whole, KEY)
    asked = _next_rows(rows)
    theirs = [f"next_{k}" for k in KEY]
    given = whole.join(own, KEY).select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("text").alias("from"), F.col("print").alias("next_print"))
    sent = given.join(asked, theirs).select(*KEY, "n_chars", "times", "next_print",
                                            F.expr("substring(from, 1, int(n_chars div 4))").alias("head"))
    cut = whole.join(sent, KEY).withColumn("stays", F.expr("substring(text, 1, int(n_chars - n_chars div 4))"))
    line = F.substring_index("stays", "\n", -1)  # the line that is cut, as far as it stays
    old = F.concat(line, F.expr("substring(text, 1 + int(n_chars - n_chars div 4), int(n_chars div 4))"))
    edited_sha256 = F.sha2(F.concat("stays", "head"), 256).alias("edited_sha256")
    carried = [*KEY, "n_chars", "times", "next_print", "edited_sha256"]
    tails = cut.select(*KEY, "n_chars", "times", "next_print", edited_sha256, F.inline(F.array(
        F.struct(F.lit(False).alias("new"), old.alias("text")), F.struct(F.lit(True).alias("new"), F.concat(line, "head").alias("text")))))
    sides = [F.max(F.when(F.col("new") == new, F.col("print"))).alias(name) for new, name in ((False, "lost"), (True, "gained"))]
    changes = fingerprints(tails, [*carried, "new"]).groupBy(*carried).agg(*sides)
    both = changes.join(own, KEY).withColumn("edited_print", plus(minus(F.col("print"), F.col("lost")), F.col("gained")))
    out = both.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "print", "edited_print",
                      likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                      likeness(F.col("print"), F.col("next_print")).alias("near_next"), "times")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
