"""Attribution strings: ``model=...; harness=...; run=...`` with an optional ``role=...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import let, strip, text, unusable


def normalise_actor(value: Column) -> Column:
    """Lower case, every run of other characters as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(value)), r"[^\p{L}\p{N}]+", " "))


def actor_identity(value: Column) -> Column:
    """struct(model, harness, run) of normalised parts, or null when it cannot be compared.

    A value without a separator cannot hold the three fields and is not taken apart.
    """
    allowed = fixed.ACTOR_FIELDS + fixed.ACTOR_OPTIONAL_FIELDS

    def pair(segment: Column) -> Column:
        at = F.instr(segment, "=")
        return F.struct(
            F.lower(strip(F.when(at > 0, F.substring(segment, F.lit(1), at - 1)))).alias("key"),
            strip(F.when(at > 0, F.substring(segment, at + 1, F.length(segment)))).alias("part"))

    def identity(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        needed = F.array(*[F.lit(k) for k in fixed.ACTOR_FIELDS])
        well_formed = (
            F.forall(pairs, lambda p: p["key"].isin(allowed) & ~unusable(p["part"]))
            & (F.size(F.array_distinct(keys)) == F.size(keys))
            & (F.size(F.array_except(needed, keys)) == 0))

        def part(key: str) -> Column:
            hits = F.filter(pairs, lambda p: p["key"] == key)
            return normalise_actor(F.get(hits, F.lit(0))["part"]).alias(key)

        return F.when(well_formed, F.struct(*[part(key) for key in fixed.ACTOR_FIELDS]))

    return F.when(F.contains(text(value), F.lit(";")), let(F.transform(F.split(text(value), ";"), pair), identity))


def name_tokens(value: Column) -> Column:
    """The distinct words of a normalised name; an empty array for a name without content."""
    return F.array_remove(F.array_distinct(F.split(normalise_actor(value), " ")), "")


def is_recorded_authority(value: Column, authorities: list[str]) -> Column:
    """Whether an actor equals one of the recorded authorities, ignoring case and punctuation."""
    wanted = [normalise_actor(F.lit(name)) for name in authorities]
    return value.isNotNull() & normalise_actor(value).isin(*wanted)
