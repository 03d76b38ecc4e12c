"""Project bindings: which contract a project is checked under, and the instruments it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import iso_date, sha256_form, strip
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.sources import records as rec

ARM = "MANIFEST"


def resolved(projects: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add the binding's state and the contract in force to ``projects``.

    ``projects`` has project_id, requested (a contract name or null) and through_ord; ``bindings``
    has project_id and value.
    """
    rows = projects.join(bindings, "project_id", "left").withColumn("v", rec.record(F.col("value")))
    rows = rows.withColumn("state", rec.state(F.col("value"), F.col("v")))
    wrong_type = (F.col("state") == "ok") & ~rec.string_part(F.col("v"), "manifest_type").eqNullSafe(
        fixed.BINDING_TYPE)
    rows = rows.withColumns({
        "state": F.when(wrong_type, "wrong_type").otherwise(F.col("state")),
        "asked": F.lower(strip(F.col("requested"))),
        "bound": F.lower(strip(rec.string_part(F.col("v"), "contract")))})
    asked = F.when(F.col("asked").isin(fixed.CONTRACTS), F.col("asked")).otherwise(
        fixed.DEFAULT_CONTRACT)
    bound_known = (F.col("state") == "ok") & F.col("bound").isin(fixed.CONTRACTS)
    fallback = F.when(F.col("requested").isNotNull(), asked).otherwise(fixed.DEFAULT_CONTRACT)
    return rows.withColumn("contract", F.when(bound_known, F.col("bound")).otherwise(fallback))


def resolution_findings(rows: DataFrame) -> DataFrame:
    """How the contract was found. ``rows`` come from ``resolved``."""
    explicit = F.col("requested").isNotNull()
    known_ask = F.col("asked").isin(fixed.CONTRACTS)
    ok, missing = F.col("state") == "ok", F.col("state") == "missing"
    legacy_ask = explicit & F.col("asked").isin(fixed.LEGACY_CONTRACTS)
    in_force = F.when(known_ask, F.col("asked")).otherwise(fixed.DEFAULT_CONTRACT)
    bound_known = F.col("bound").isin(fixed.CONTRACTS)
    return apply_rules(rows, ARM, [
        Rule("requested_unknown", explicit & ~known_ask, F.col("requested")),
        Rule("binding_missing", missing & ~legacy_ask),
        Rule("legacy_without_binding", missing & legacy_ask, severity="note"),
        Rule("binding_invalid", ~ok & ~missing, F.col("state")),
        Rule("contract_conflict", explicit & ok & (F.col("bound") != in_force), F.col("bound")),
        Rule("bound_contract_unknown", ok & ~bound_known, F.col("bound")),
        Rule("legacy_needs_request", ~explicit & ok & F.col("bound").isin(fixed.LEGACY_CONTRACTS),
             F.col("bound")),
        Rule("binding_not_held", missing & (F.col("contract") == "v0.3")),
    ])


def instrument_findings(rows: DataFrame, instruments: DataFrame, recognised: DataFrame,
                        observed: DataFrame | None = None) -> DataFrame:
    """The bound instruments against the catalogue.

    ``instruments`` has contract, key, file; ``recognised`` has contract, file, sha256; ``observed``
    has contract, file, file_sha256. Apply only where the catalogue itself is valid.
    """
    bound = rows.filter("state = 'ok'")
    date = rec.string_part(F.col("v"), "bound_date")
    metadata = rec.entries(rec.part(F.col("v"), "instruments"))
    head = apply_rules(bound, ARM, [
        Rule("binding_schema", ~rec.string_part(F.col("v"), "schema_version")
             .eqNullSafe(fixed.BINDING_SCHEMA_VERSION)),
        Rule("bound_date_invalid", date.isNull() | iso_date(date).isNull()),
        Rule("instruments_missing", metadata.isNull()),
    ])
    each = (bound.filter(metadata.isNotNull()).join(instruments, "contract")
            .withColumn("item", F.try_element_at(metadata, F.col("key")))
            .withColumns({"item_file": rec.string_part(F.col("item"), "file"),
                          "item_version": rec.string_part(F.col("item"), "version"),
                          "item_sha256": rec.string_part(F.col("item"), "sha256")}))
    known = recognised.select("contract", "file", F.col("sha256").alias("item_sha256"),
                              F.lit(True).alias("known")).distinct()
    each = each.join(known, ["contract", "file", "item_sha256"], "left")
    if observed is None:
        each = each.withColumn("file_sha256", F.lit(None).cast("string"))
    else:
        each = each.join(observed, ["contract", "file"], "left")
    version = F.lit(None).cast("string")
    for contract, value in fixed.CONTRACT_VERSIONS.items():
        version = F.when(F.col("contract") == contract, value).otherwise(version)
    listed = rec.is_object(F.col("item"))
    formed = listed & F.col("item_sha256").isNotNull() & sha256_form(F.col("item_sha256"))
    looked = formed & F.lit(observed is not None)
    return union_all([head, apply_rules(each, ARM, [
        Rule("instrument_missing", ~listed),
        Rule("instrument_file", listed & ~F.col("item_file").eqNullSafe(F.col("file")),
             F.col("item_file")),
        Rule("instrument_version", listed & ~F.col("item_version").eqNullSafe(version),
             F.col("item_version")),
        Rule("instrument_hash_form", listed & ~formed),
        Rule("instrument_hash_unrecognised", formed & F.col("known").isNull(),
             F.col("item_sha256")),
        Rule("instrument_bytes_missing", looked & F.col("file_sha256").isNull()),
        Rule("instrument_bytes_differ", looked & (F.col("file_sha256") != F.col("item_sha256")),
             F.col("file_sha256")),
    ], F.col("key"))])
