"""Who-said attributions of drafts, and whether a source carries the subject in a clean context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions import prose
from auditloom.functions.text import let, strip
from auditloom.operators.grounding import folded_evidence
from auditloom.operators.registers import gathered
from auditloom.session import written

MARK = "\x01"
REACH = fixed.NEGATION_REACH
# Sources of a draft are numbered in blocks so that a draft with a very long list is positioned by
# many tasks; only one row per block is ordered over the whole draft.
BLOCK = 4096
# Characters of an index entry, and how many keys of a draft are tested one by one: a walk over a
# source's grams costs as much as some hundred searches.
GRAM, DIRECT = 4, 256


def attributions(drafts: DataFrame) -> DataFrame:
    """(draft_id, key, subject, sentence): the first sentence that attributes to each subject."""
    return first_attributions(drafts.select("draft_id", F.posexplode(prose.sentences(F.col("text")))
                                            .alias("sent_no", "sentence")))


def first_attributions(sentences: DataFrame) -> DataFrame:
    """The same from a table of sentences (draft_id, sent_no, sentence).

    Spans are exploded as they are found, so a sentence that attributes nothing leaves no row behind.
    """
    spans = sentences.select("draft_id", "sent_no", "sentence", F.posexplode(
        prose.attribution_spans(F.col("sentence"))).alias("pattern", "spans"))
    found = (spans.select("draft_id", "sent_no", "sentence", "pattern", F.posexplode("spans").alias("match", "span"))
             .withColumn("subject", strip(F.col("span")))
             .filter(~F.lower("subject").isin(fixed.ATTRIBUTION_STOP_SUBJECTS)))
    first = F.min(F.struct("sent_no", "pattern", "match", "subject", "sentence"))
    return (found.groupBy("draft_id", F.lower("subject").alias("key")).agg(first.alias("f"))
            .select("draft_id", "key", "f.subject", "f.sentence"))


def _occurrences(low: Column, key: Column) -> Column:
    """array<struct<negated, short_left, short_right>>, one per non-overlapping occurrence.

    The text is cut in front of every occurrence. The window of an occurrence is put together from
    the nearest pieces, trimmed to the reach, so the cost is linear in the text. ``short_*`` says
    how many characters of the window lie outside this source.
    """
    size = F.length(key)
    near = F.ceil(F.lit(REACH) / size).cast("int") + 1

    def judged(ends: Column) -> Column:
        tails, heads = ends["tails"], ends["heads"]

        def window(i: Column) -> Column:
            start = F.greatest(i - near + 1, F.lit(1))
            before = F.right(F.array_join(F.slice(tails, start, i - start + 1), ""), F.lit(REACH))
            after = F.left(F.array_join(F.slice(heads, i + 1, near), ""), size + REACH)
            return F.struct(before.alias("before"), after.alias("after"))

        windows = F.transform(F.sequence(F.lit(1), F.size(tails) - 1), window)
        return F.transform(windows, lambda w: F.struct(
            F.concat(w["before"], w["after"]).rlike(fixed.NEGATION).alias("negated"),
            (REACH - F.length(w["before"])).alias("short_left"),
            (size + REACH - F.length(w["after"])).alias("short_right")))

    pieces = F.split(F.replace(low, key, F.concat(F.lit(MARK), key)), MARK)
    return let(let(pieces, lambda ps: F.struct(
        F.transform(ps, lambda p: F.right(p, F.lit(REACH))).alias("tails"),
        F.transform(ps, lambda p: F.left(p, size + REACH)).alias("heads"))), judged)


def _cue_distance(chars: Column, from_end: bool) -> Column:
    """Fewest characters, counted from one end, that hold a whole negation cue; else null."""
    def nearest(body: Column) -> Column:
        ends = [(cue[::-1] if from_end else cue) for cue in fixed.NEGATION_CUES]
        return F.least(*[F.when(F.instr(body, end) > 0, F.instr(body, end) - 1 + len(end))
                         for end in ends])

    folded = F.translate(chars, "ſı", "si")
    return F.when(chars.rlike(fixed.NEGATION),
                  let(F.reverse(folded) if from_end else folded, nearest))


def negation_nearby(evidence: DataFrame, block: int = BLOCK) -> DataFrame:
    """(draft_id, source_ord, left_at, right_at): how far outside a source the next cue reaches.

    Sources are read as one text joined by line breaks, in source order. ``left_at`` is the number
    of characters before the source that have to be seen to hold a whole cue, ``right_at`` the same
    after it; null for none. A cue never spans a line break, so these two numbers are all an
    occurrence near an end of its source needs to know of its neighbours.
    """
    low = F.col("low")
    rows = folded_evidence(evidence).select(
        "draft_id", "source_ord", F.floor(F.col("source_ord") / block).alias("block"),
        F.length(low).cast("bigint").alias("len"),
        _cue_distance(F.right(low, F.lit(REACH)), True).alias("from_end"),
        _cue_distance(F.left(low, F.lit(REACH)), False).alias("from_start"))
    inner = Window.partitionBy("draft_id", "block").orderBy("source_ord")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    # read backwards, so that the frame grows row by row instead of being rebuilt for each row
    after = (Window.partitionBy("draft_id", "block").orderBy(F.desc("source_ord"))
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("at", F.coalesce(F.sum(F.col("len") + 1).over(before),
                                              F.lit(0).cast("bigint")))
    placed = placed.withColumns({"cue_start": F.col("at") + F.col("len") - F.col("from_end"),
                                 "cue_end": F.col("at") + F.col("from_start")})
    placed = placed.withColumns({"prev": F.max("cue_start").over(before),
                                 "next": F.min("cue_end").over(after)})
    blocks = placed.groupBy("draft_id", "block").agg(
        F.sum(F.col("len") + 1).alias("width"), F.max("cue_start").alias("last_cue"),
        F.min("cue_end").alias("first_cue"))
    outer = Window.partitionBy("draft_id").orderBy("block")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    later = (Window.partitionBy("draft_id").orderBy(F.desc("block"))
             .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("width").over(earlier),
                                                  F.lit(0).cast("bigint")))
    blocks = blocks.withColumns({
        "prev_cue": F.max(F.col("base") + F.col("last_cue")).over(earlier),
        "next_cue": F.min(F.col("base") + F.col("first_cue")).over(later)}
    ).select("draft_id", "block", "base", "prev_cue", "next_cue")
    at = F.col("base") + F.col("at")
    return placed.join(blocks, ["draft_id", "block"]).select(
        "draft_id", "source_ord",
        (at - F.greatest(F.col("base") + F.col("prev"), F.col("prev_cue"))).alias("left_at"),
        (F.least(F.col("base") + F.col("next"), F.col("next_cue")) - at - F.col("len"))
        .alias("right_at"))


def _rarest(keys: DataFrame) -> DataFrame:
    """(draft_id, kind, key, gram): every key with the one of its grams that the fewest keys have."""
    grams = keys.select("draft_id", "kind", "key", F.explode(F.array_distinct(_grams(F.col("key")))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return (grams.join(counts, "gram").groupBy("draft_id", "kind", "key")
            .agg(F.min(F.struct("n", "gram")).alias("g")).select("draft_id", "kind", "key", "g.gram"))


def _grams(low: Column) -> Column:
    """All overlapping pieces of a text of the gram's length, in one walk."""
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def _in_blocks(evidence: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """Evidence with its draft's list, which is repeated for every block of sources."""
    place = F.floor(F.col("source_ord") / block).alias("block")
    blocks = evidence.select("draft_id", place).distinct().join(lists, "draft_id")
    return evidence.select("*", place).join(blocks, ["draft_id", "block"]).drop("block")


def _named_directly(folded: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """(draft_id, source_ord, low, k): every key of the draft is looked for in every source."""
    met = _in_blocks(folded, lists, block).select("draft_id", "source_ord", "low", F.explode("keys").alias("k"))
    return met.filter(F.contains(F.col("low"), F.col("k.key")))


def _named_by_index(folded: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """The same through an inverted index of grams.

    A key is entered under its rarest gram. A source sends on the grams it shares with its draft's
    entries, whatever the number of keys; only keys whose gram it has are looked for in it.
    """
    entries, _ = written(_rarest(keys))
    lists = entries.groupBy("draft_id").agg(F.collect_set("gram").alias("grams"))
    shared = F.array_intersect(_grams(F.col("low")), F.col("grams"))
    met = _in_blocks(folded, lists, block).select("draft_id", "source_ord", F.explode(shared).alias("gram"))
    near = (met.join(entries, ["draft_id", "gram"]).groupBy("draft_id", "source_ord")
            .agg(F.collect_set(F.struct("kind", "key")).alias("keys")))
    return folded.join(near, ["draft_id", "source_ord"]).select(
        "draft_id", "source_ord", "low", F.explode(F.filter("keys", lambda k: F.contains(F.col("low"), k["key"]))).alias("k"))


def evidence_hits(wanted: DataFrame, evidence: DataFrame, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """(draft_id, source_ord, kind, key, clean, edges): which sources contain which folded keys.

    ``wanted`` has draft_id, kind ('name' or 'subject') and key. Evidence texts move once, on draft
    and block of its sources, so a draft with a long list is searched by many tasks. A draft with
    few keys has them tested one by one. Where it has more than ``direct``, keys of a gram's length
    or more are found through an index, and only the shorter ones, of which no alphabet has many,
    are tested one by one; both ways find the same. For subjects ``clean`` is decided inside the
    source and ``edges`` lists occurrences whose window leaves it.
    """
    many = F.size("keys") > direct
    short = F.filter("keys", lambda k: F.length(k["key"]) < GRAM)
    long = F.filter("keys", lambda k: F.length(k["key"]) >= GRAM)
    lists, seen = written(gathered(wanted, "draft_id").agg(F.collect_set(F.struct("kind", "key")).alias("keys")),
                          F.count_if(many).alias("many"))
    folded = folded_evidence(evidence).withColumn("low", F.replace("low", F.lit(MARK), F.lit("\x02")))
    if not seen["many"]:
        met = _named_directly(folded, lists, block)
    else:
        some = lists.select("draft_id", F.when(many, short).otherwise(F.col("keys")).alias("keys")).filter(F.size("keys") > 0)
        keys = lists.filter(many).select("draft_id", F.explode(long).alias("k")).select("draft_id", "k.kind", "k.key")
        met = _named_directly(folded, some, block).unionByName(_named_by_index(folded, keys, block))
    subject = F.col("k.kind") == "subject"
    seen_at = met.select("draft_id", "source_ord", "k.kind", "k.key",
                         F.when(subject, _occurrences(F.col("low"), F.col("k.key"))).alias("seen"))
    inside = lambda o: (o["short_left"] == 0) & (o["short_right"] == 0)
    return seen_at.select(
        "draft_id", "source_ord", "kind", "key",
        F.exists("seen", lambda o: ~o["negated"] & inside(o)).alias("clean"),
        F.array_distinct(F.transform(
            F.filter("seen", lambda o: ~o["negated"] & ~inside(o)),
            lambda o: F.struct(o["short_left"].alias("l"), o["short_right"].alias("r"))))
        .alias("edges"))


def wanted_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.select("draft_id", F.lit("subject").alias("kind"), "key")


def attribution_binding(drafts: DataFrame, evidence: DataFrame,
                        block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """(draft_id, key, subject, sentence, status): ABSENT, NEGATED or PRESENT per attribution."""
    subjects, _ = written(attributions(drafts))
    return bound(subjects, evidence_hits(wanted_subjects(subjects), evidence, block, direct), evidence, block)


def bound(subjects: DataFrame, hits: DataFrame, evidence: DataFrame, block: int = BLOCK,
          open_ends: bool = True) -> DataFrame:
    """The status of every subject, given the places where sources name it.

    ``open_ends`` says whether any hit has edges; without them no hit asks what stands beside its source.
    """
    named = hits.filter("kind = 'subject'")
    if open_ends:
        free = (lambda e: (F.col("left_at").isNull() | (e["l"] < F.col("left_at")))
                & (F.col("right_at").isNull() | (e["r"] < F.col("right_at"))))
        named = named.join(negation_nearby(evidence, block), ["draft_id", "source_ord"], "left").withColumn(
            "clean", F.col("clean") | F.exists("edges", free))
    judged = named.select("draft_id", "key", "clean")
    found = judged.groupBy("draft_id", "key").agg(F.max("clean").alias("clean"))
    status = (F.when(F.col("clean").isNull(), "ABSENT").when(F.col("clean"), "PRESENT")
              .otherwise("NEGATED"))
    return subjects.join(found, ["draft_id", "key"], "left").select(
        "draft_id", "key", "subject", "sentence", status.alias("status"))
