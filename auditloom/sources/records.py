"""JSON records (review, approval, policy, binding): parsed to VARIANT, types tested, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import let, text


def record(value: Column) -> Column:
    return F.try_parse_json(value)


def state(value: Column, parsed: Column | None = None) -> Column:
    """'missing', 'malformed', 'not_object' or 'ok'; ``parsed`` is the record, where it is at hand."""
    parsed = record(value) if parsed is None else parsed
    return (F.when(value.isNull(), "missing").when(parsed.isNull(), "malformed")
            .when(~is_object(parsed), "not_object").otherwise("ok"))


def kind(variant: Column) -> Column:
    """The variant's type name, '' for an absent value."""
    return F.coalesce(F.schema_of_variant(variant), F.lit(""))


def part(variant: Column, key: str) -> Column:
    return F.try_variant_get(variant, f"$.{key}", "variant")


def as_string(variant: Column) -> Column:
    """The text of a JSON string; null for every other type."""
    return F.when(kind(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def string_part(variant: Column, key: str) -> Column:
    """The text of the JSON string called ``key``, read by its path; null for every other type."""
    return F.when(kind(part(variant, key)) == "STRING", F.try_variant_get(variant, f"$.{key}", "string"))


def is_object(variant: Column) -> Column:
    """Whether the variant is an object; what it holds is not looked at, unlike in its type name."""
    return F.try_variant_get(variant, "$", "struct<>").isNotNull()


def is_list(variant: Column) -> Column:
    return kind(variant).startswith("ARRAY")


def entries(variant: Column, key: str | None = None) -> Column:
    """map<string, variant> of an object, or of the part called ``key``; null for every other type.

    A part is read straight into the map: as a variant of its own it would be built anew first.
    """
    return F.try_variant_get(variant, "$" if key is None else f"$.{key}", "map<string,variant>")


def items(variant: Column) -> Column:
    """array<variant> of a list; null for every other type."""
    return F.when(is_list(variant), F.try_variant_get(variant, "$", "array<variant>"))


def strings(variant: Column) -> Column:
    """array<string> of a list that holds strings only; null otherwise."""
    return let(items(variant), lambda held: F.when(
        F.forall(held, lambda v: kind(v) == "STRING"), F.transform(held, as_string)))


def project_records(texts: DataFrame, file_name: str) -> DataFrame:
    """(project_id, value) of one record file over all projects, out of a text scan."""
    return texts.filter(F.col("rel_path") == file_name).select(
        "project_id", text(F.col("text")).alias("value"))
