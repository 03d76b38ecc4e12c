"""Quality rules whose cutoffs carry a guarantee against false rejection.

Each rule scores a document (higher is worse). On labelled holdouts, per stratum, a cutoff is allowed
only if the exact binomial test rejects "more than ``risk`` of the good documents exceed it".
Cutoffs are tested from the loosest to the strictest and testing stops at the first that fails
(fixed sequence), so one error probability serves the whole grid; it is divided by the number of
(stratum, rule) pairs (Bonferroni). With probability ``1 - error`` no allowed rule of any stratum
rejects more than ``risk / rules`` of its good documents, hence all rules together at most ``risk``.
A stratum with too few labels gets no cutoff and rejects nothing.

Everything is DataFrame expressions. Defined cases: a null text has no words and fails the base
rules; a null stratum is the stratum ''; labels that are repeated count once, as bad if they
disagree; labels without a document and documents without a label or id are fine; an empty label
table allows no cutoff; extra columns are carried by ``judged`` unless it adds one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.words import let, words
from auditloom.session import written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Cutoffs per rule, loosest first. A document is rejected when its score is greater.
CUTOFFS = {
    "symbols": [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "repeats": [0.28, 0.25, 0.2, 0.15],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}


def _count(text: Column, characters: str) -> Column:
    """How many of the text's characters are of this kind: the runs of all others are cut out."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the text.

    Windows are compared by 64-bit hash within one document. Only a document in which a hash repeats
    sorts its windows; the covered words are then counted in one walk over the repeated starts.
    """
    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            again = F.filter(rows, lambda r, k: (F.get(rows, k - 1)["h"] == r["h"])
                             | F.coalesce(F.get(rows, k + 1)["h"] == r["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda r: r["i"]))

        def add(state: Column, start: Column) -> Column:
            return F.struct((state["n"] + start + WINDOW - F.greatest(start, state["end"])).alias("n"),
                            (start + WINDOW).alias("end"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(ordered, starts), zero, add, lambda s: s["n"].cast("long"))

    def windows(hashed: Column) -> Column:
        # The eight values are taken one by one: a slice would be a new array for every word.
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))

    def counted(hashed: Column) -> Column:
        return let(windows(hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .otherwise(covered(h)))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashed, counted))


def measures(text: Column) -> Column:
    """The counts of one text as a struct."""
    text = F.coalesce(text, F.lit(""))

    def count(tokens: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
        return let(lines, lambda ls: F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.aggregate(tokens, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(ls).cast("long").alias("n_lines"),
            _count(text, "A-Z").alias("n_capitals"),
            repeat_words(tokens).alias("n_repeat_words")))

    return let(words(text), count)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def scores(m: Column) -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return m[part] / F.greatest(m[whole], F.lit(1))

    return {"symbols": share("n_symbols", "n_words"), "duplicate_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def log_tail(n: Column, x: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= x), summed term by term in logarithms."""
    odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    first = n * F.log(F.lit(1 - p))

    def add(state: Column, j: Column) -> Column:
        def summed(term: Column) -> Column:
            top = F.greatest(state["sum"], term)
            total = top + F.log(F.exp(state["sum"] - top) + F.exp(term - top))
            return F.struct(term.alias("term"), total.alias("sum"))

        return let(state["term"] + F.log((n - j + 1) / j) + odds, summed)

    steps = F.filter(F.sequence(F.lit(0).cast("long"), x), lambda j: j > 0)
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda s: s["sum"])


def safe_cutoffs(held: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """One row per stratum: ``cut``, a map from rule to the strictest allowed cutoff.

    ``held`` has doc_id, stratum and m (measures). One row per document is joined with its label;
    after that there is one row per stratum. The result is landed, so that its size is known where
    it meets the documents.
    """
    per_rule = risk / len(CUTOFFS)
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = held.where(~base_failed(F.col("m"))).join(good, "doc_id", "left_semi")
    score = scores(F.col("m"))
    over = [F.sum((score[rule] > c).cast("long")).alias(f"{rule}_{k}")
            for rule, grid in CUTOFFS.items() for k, c in enumerate(grid)]
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    tests = counts.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("k"), F.lit(c).alias("cutoff"),
                 F.col(f"{rule}_{k}").alias("x"))
        for rule, grid in CUTOFFS.items() for k, c in enumerate(grid)])).alias("t")).select("stratum", "n", "t.*")
    strata = held.agg(F.count_distinct("stratum")).scalar()
    level = F.log(F.lit(error / len(CUTOFFS)) / F.greatest(strata, F.lit(1)))
    # A count at or above its expectation cannot pass, so its long sum is not taken.
    passed = F.when(F.col("x") >= F.col("n") * per_rule, F.lit(False)).otherwise(
        log_tail(F.col("n"), F.col("x"), per_rule) <= level)
    so_far = Window.partitionBy("stratum", "rule").orderBy("k")
    allowed = tests.withColumn("passed", passed).withColumn("passed", F.min("passed").over(so_far)).where("passed")
    chosen = allowed.groupBy("stratum", "rule").agg(F.max_by("cutoff", "k").alias("cutoff"))
    return written(chosen.groupBy("stratum").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cutoff")))).alias("cut")))[0]


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and measures of every document, written once."""
    return written(docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
                               measures(F.col("text")).alias("m")))[0]


def verdict(m: Column, cut: Column) -> Column:
    rejects = [F.coalesce(score > F.try_element_at(cut, F.lit(rule)), F.lit(False))
               for rule, score in scores(m).items()]
    rejected = rejects[0]
    for one in rejects[1:]:
        rejected = rejected | one
    return ~base_failed(m) & ~rejected


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows that have ``stratum`` and ``m``.

    ``cutoffs`` has one row per stratum with a cutoff, a stratum being a language or a source.
    """
    met = rows.join(cutoffs, "stratum", "left")
    return (met.withColumn("base_failed", base_failed(F.col("m")))
            .withColumn("kept", verdict(F.col("m"), F.col("cut"))).drop("cut"))


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02,
            error: float = 0.05) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    held = measured(docs, stratum)
    rows = judged(held, safe_cutoffs(held, labels, risk, error))
    return rows.select("doc_id", "stratum", "m.*", "base_failed", "kept")
