"""The release catalogue: which instrument bytes each contract recognises.

Which instruments exist, under which file names and roots, is the releasing project's own data and
is passed in: ``instruments`` has contract, key, file; ``roots`` has contract, root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import let, sha256_form
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import contract_decisions
from auditloom.sources import records as rec

ARM = "MANIFEST"


def _contract_parts(catalogue: DataFrame) -> DataFrame:
    """One row per known contract with its part of the catalogue (absent where not listed).

    The contracts are read once and taken apart inside the generator: a filter on them would be
    pushed below it and parse every catalogue again.
    """
    def parts(listed: Column) -> Column:
        return F.when(listed.isNotNull(), F.array(*[
            F.struct(F.lit(c).alias("contract"), F.try_element_at(listed, F.lit(c)).alias("part"))
            for c in fixed.CONTRACTS]))

    listed = rec.entries(rec.record(F.col("value")), "contracts")
    return catalogue.select(F.explode(let(listed, parts)).alias("c")).select("c.contract", "c.part")


def expected_stages(spark) -> DataFrame:
    """Per contract the sorted (stage, id, question) list, and how many decisions it requires."""
    return contract_decisions(spark).groupBy("contract").agg(
        F.sort_array(F.collect_list(F.struct("stage", F.col("decision_id").alias("id"), "question")))
        .alias("stages"), F.count("*").alias("required"))


def _stages(part: Column) -> Column:
    mapped = F.try_variant_get(part, "$.stages", "map<string,map<string,string>>")
    lists = F.transform(F.map_entries(mapped), lambda s: F.transform(
        F.map_entries(s["value"]), lambda d: F.struct(
            s["key"].alias("stage"), d["key"].alias("id"), d["value"].alias("question"))))
    return F.sort_array(F.flatten(lists))


def recognised_hashes(catalogue: DataFrame) -> DataFrame:
    """(contract, file, sha256): the exploded allow-lists."""
    lists = rec.entries(F.col("part"), "hashes")
    files = _contract_parts(catalogue).select("contract", F.explode(lists).alias("file", "hashes"))
    return files.select("contract", "file", F.explode(rec.strings(F.col("hashes"))).alias("sha256"))


def catalogue_findings(catalogue: DataFrame, instruments: DataFrame, roots: DataFrame,
                       observed: DataFrame | None = None) -> DataFrame:
    """Errors of the catalogue itself. ``catalogue`` is one row with ``value`` (the JSON text).

    ``observed`` (contract, file, file_sha256) adds the check of the released bytes.
    """
    rows = catalogue.select(F.lit("").alias("project_id"), "value", rec.record(F.col("value")).alias("v"))
    rows = rows.withColumn("state", rec.state(F.col("value"), F.col("v")))
    v, ok = F.col("v"), F.col("state") == "ok"
    rows = rows.withColumn("names", F.map_keys(rec.entries(v, "contracts")))
    names = F.col("names")
    known = F.array(*[F.lit(c) for c in fixed.CONTRACTS])
    root_rules = apply_rules(rows, ARM, [
        Rule("catalogue_unreadable", ~ok, F.col("state")),
        Rule("catalogue_type", ok & ~rec.string_part(v, "manifest_type")
             .eqNullSafe(fixed.CATALOGUE_TYPE)),
        Rule("catalogue_schema", ok & ~rec.string_part(v, "schema_version")
             .eqNullSafe(fixed.CATALOGUE_SCHEMA_VERSION)),
        Rule("catalogue_default", ok & ~rec.string_part(v, "default_contract")
             .eqNullSafe(fixed.DEFAULT_CONTRACT)),
        Rule("catalogue_contracts_not_object", ok & names.isNull()),
        Rule("catalogue_contract_set", ok & names.isNotNull() & (
            F.array_sort(names) != F.array_sort(known))),
    ])
    parts = _contract_parts(catalogue).withColumn("project_id", F.lit(""))
    joined = (parts.join(expected_stages(catalogue.sparkSession), "contract")
              .join(roots, "contract", "left"))
    part, listed = F.col("part"), rec.is_object(F.col("part"))
    version = F.lit(None).cast("string")
    for contract, key in fixed.CONTRACT_VERSION_FIELDS.items():
        version = F.when(F.col("contract") == contract, rec.string_part(part, key) ==
                         fixed.CONTRACT_VERSIONS[contract]).otherwise(version)
    count = F.when(rec.kind(rec.part(part, "required_decisions")) == "BIGINT",
                   F.try_variant_get(part, "$.required_decisions", "bigint"))
    contract_rules = apply_rules(joined, ARM, [
        Rule("contract_not_object", ~listed),
        Rule("contract_version", listed & ~F.coalesce(version.cast("boolean"), F.lit(False))),
        Rule("contract_root", listed & ~rec.string_part(part, "instrument_root")
             .eqNullSafe(F.col("root"))),
        Rule("contract_required", listed & ~count.eqNullSafe(F.col("required"))),
        Rule("contract_stages", listed & ~_stages(part).eqNullSafe(F.col("stages"))),
        Rule("contract_hashes", listed & rec.entries(part, "hashes").isNull()),
    ], F.col("contract"))
    lists = rec.entries(part, "hashes")
    files = (parts.select("project_id", "contract", lists.alias("lists")).filter("lists IS NOT NULL")
             .join(instruments, "contract")
             .withColumn("allowed", F.try_element_at("lists", F.col("file"))).drop("lists"))
    if observed is None:
        files = files.withColumn("file_sha256", F.lit(None).cast("string"))
    else:
        files = files.join(observed, ["contract", "file"], "left")
    some = F.coalesce(F.size(rec.items(F.col("allowed"))) > 0, F.lit(False))
    formed = F.coalesce(F.forall(rec.strings(F.col("allowed")), sha256_form), F.lit(False))
    looked = some & formed & F.lit(observed is not None)
    file_rules = apply_rules(files, ARM, [
        Rule("hashes_missing", ~some, F.col("file")),
        Rule("hash_form", some & ~formed, F.col("file")),
        Rule("released_file_missing", looked & F.col("file_sha256").isNull(), F.col("file")),
        Rule("released_bytes_unrecognised", looked & F.col("file_sha256").isNotNull()
             & ~F.array_contains(rec.strings(F.col("allowed")), F.col("file_sha256")),
             F.col("file")),
    ], F.col("contract"))
    return union_all([root_rules, contract_rules, file_rules])
