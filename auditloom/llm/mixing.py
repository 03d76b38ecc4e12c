"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source's documents are cut into blocks of equal size. With weight w of a total W, block k of a source is
released at slot floor(k * W / w) and due at slot ceil((k + 1) * W / w). Earliest deadline first
gives every block a slot inside its window, so that no prefix of the mix is a whole block away from
the target.

The schedule repeats every W slots, so one round is scheduled and every block finds its slot by
division: nothing runs block after block. When sources run out, the rest go on by their own weights.
From round to round the blocks that take part only change where a source ends; each such stretch has
its own round. The table of rounds has at most (2 * sources + 1) * W rows, and neither depends on the
number of documents.

Everything is DataFrame expressions. No row is dropped or repeated. Defined cases: a null source counts as
the source ''; a null text has size 1; sources without a target get weight 1; targets without documents
are ignored; an empty table gives an empty result; repeated rows are mixed each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.prefix import running_totals
from auditloom.llm.words import let
from auditloom.session import written

BLOCK_BYTES, PERIOD = 1 << 18, 240


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def tempered(sizes: DataFrame, exponent: float = 0.5, period: int = PERIOD) -> DataFrame:
    """(source, weight): shares of ``period`` in proportion to total size ** exponent, at least 1 each."""
    totals = sizes.groupBy("source").agg(F.pow(F.sum("size").cast("double"), F.lit(exponent)).alias("p"))
    everything = totals.agg(F.sum("p")).scalar()
    share = F.round(F.col("p") / everything * period).cast("int")
    return totals.select("source", F.greatest(share, F.lit(1)).alias("weight"))


def edf(counts: Column) -> Column:
    """The order of one round: for every slot the index of the source in ``counts``, blocks of each.

    In each slot the released block with the earliest deadline, of equal ones the first source's.
    """
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)

    def schedule(length: Column) -> Column:
        def step(state: Column, slot: Column) -> Column:
            def due(c: Column, i: Column) -> Column:
                done = state["done"][i]
                ready = (done < c) & (F.floor(done * length / c) <= slot)
                return F.when(ready, F.struct(F.ceil((done + 1) * length / c).alias("due"), i.alias("i")))

            def take(first: Column) -> Column:
                return F.struct(F.array_append(state["order"], first["i"]).alias("order"),
                                F.transform(state["done"], lambda d, k: F.when(k == first["i"], d + 1).otherwise(d)).alias("done"))

            return let(F.array_min(F.transform(counts, due)), take)

        zero = F.struct(F.array().cast("array<int>").alias("order"), F.transform(counts, lambda c: F.lit(0)).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), length - 1), zero, step, lambda s: s["order"])

    return let(total, schedule)


def rounds(sources: DataFrame) -> DataFrame:
    """Slots of all kinds of rounds, from one row (source, weight, blocks) per source.

    Rounds first_round to last_round - 1 are alike: block ``nth`` of the source in round r has slot
    start + (r - first_round) * length + place.
    """
    whole = F.expr("blocks div weight")
    ends = sources.select(F.explode(F.array(F.lit(0).cast("long"), whole, F.ceil(F.col("blocks") / F.col("weight")))).alias("cut"))
    cuts = ends.agg(F.array_sort(F.collect_set("cut"))).scalar()  # 2 per source
    spans = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c, i: F.struct(
        c.alias("first_round"), F.element_at("cuts", i + 2).alias("last_round")))
    taken = F.least(F.col("weight").cast("long"), F.col("blocks") - F.col("first_round") * F.col("weight"))
    kinds = (sources.withColumn("cuts", cuts).select("*", F.explode(spans).alias("span")).select("source", "weight", "blocks", "span.*")
             .where("first_round * weight < blocks").groupBy("first_round", "last_round")
             .agg(F.array_sort(F.collect_list(F.struct("source", taken.cast("int").alias("n")))).alias("own")))
    kinds = kinds.withColumn("order", edf(F.col("own.n"))).withColumn("length", F.size("order").cast("long"))
    earlier = Window.orderBy("first_round").rowsBetween(Window.unboundedPreceding, -1)
    slots = (F.col("last_round") - F.col("first_round")) * F.col("length")
    kinds = kinds.withColumn("start", F.coalesce(F.sum(slots).over(earlier), F.lit(0)))
    places = kinds.select("first_round", "last_round", "length", "start", "own", F.posexplode("order").alias("place", "i"))
    before = Window.partitionBy("first_round", "i").orderBy("place")
    return places.select("first_round", "last_round", "length", "start", "place", F.col("own")[F.col("i")]["source"].alias("source"),
                         (F.row_number().over(before) - 1).cast("long").alias("nth"))


def mixed(rows: DataFrame, weights: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add block and slot to rows of source, size, key and other columns.

    Inside a source documents follow the order of ``key``. ``weights`` has source and weight, an int.
    A document belongs to the block in which it begins; a long one covers several, which then stand empty.
    """
    placed = running_totals(rows, ["source"], ["key"], F.col("size"), "before")
    numbered, _ = written(placed.withColumn("block", F.floor(F.col("before") / block_bytes).cast("long")))
    have = numbered.groupBy("source").agg((F.max("block") + 1).alias("blocks"))
    targets = weights.groupBy("source").agg(F.greatest(F.max("weight"), F.lit(1)).alias("weight"))
    sources, _ = written(have.join(targets, "source", "left").select(
        "source", "blocks", F.coalesce("weight", F.lit(1)).alias("weight")))
    blocks = (numbered.select("source", "block").distinct().join(sources, "source")
              .withColumn("round", F.expr("block div weight")).withColumn("nth", F.col("block") % F.col("weight")))
    slots = (blocks.join(rounds(sources), ["source", "nth"]).where("round >= first_round AND round < last_round")
             .select("source", "block", (F.col("start") + (F.col("round") - F.col("first_round")) * F.col("length")
                                         + F.col("place")).alias("slot")))
    return numbered.join(slots, ["source", "block"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), size_of(F.col("text")).alias("size"),
                       F.xxhash64("doc_id", "source", "text").alias("key"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, source, size, key, before, block and slot of every document.

    Without weights the targets are tempered: the square roots of the sources' sizes.
    """
    rows = _narrow(docs)
    return mixed(rows, tempered(rows) if weights is None else weights, block_bytes)


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs``, dealt by range of slot and sorted, so files and partitions follow the mix."""
    slots = mix(docs, weights, block_bytes).groupBy("key").agg(F.min("slot").alias("__slot"))
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "source", "text"))
    met = keyed.join(slots.withColumnRenamed("key", "__key"), "__key")
    return met.repartitionByRange("__slot", "__key").sortWithinPartitions("__slot", "__key").select(*docs.columns)
