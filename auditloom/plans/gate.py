"""The gate over a folder of projects: scan, resolve contracts, run every arm, one findings table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators import (approval, binding, claims, decisions, derivation, drafts,
                                 feasibility, review, sources, vocabulary)
from auditloom.functions.routes import held_path
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import stage_order
from auditloom.session import configure, written
from auditloom.sources import catalogue as cat
from auditloom.sources.custody import scan_held
from auditloom.sources.records import project_records
from auditloom.sources.registers import presence_findings, read_register
from auditloom.sources.texts import scan_drafts, scan_texts


class Release(NamedTuple):
    """What the releasing project publishes: its catalogue and the instruments it names."""

    catalogue: DataFrame
    instruments: DataFrame
    roots: DataFrame
    observed: DataFrame | None = None


class Registers(NamedTuple):
    decisions: DataFrame
    sources: DataFrame
    claims: DataFrame
    vocabulary: DataFrame
    probes: DataFrame


def read_registers(spark: SparkSession, root: str,
                   projects: DataFrame) -> tuple[Registers, DataFrame]:
    """The five registers of all projects, landed as Parquet once, and their header findings."""
    frames, heads = [], []
    for name in ("decisions.csv", "sources.csv", "claims.csv", "vocabulary.csv",
                 "feasibility.csv"):
        rows, head = read_register(spark, root, name, projects)
        frames.append(written(rows)[0])
        heads.append(head)
    return Registers(*frames), union_all(heads)


def register_findings(projects: DataFrame, registers: Registers, held: DataFrame) -> DataFrame:
    """The arms that need registers and held files only."""
    scope = decisions.latest_scope_dates(registers.decisions)
    graph = derivation.forest(derivation.parents_of(registers.sources))
    controlled = {"sources.csv": registers.sources,
                  "claims.csv": registers.claims}
    return union_all([
        decisions.decision_findings(registers.decisions),
        sources.premature_rows(registers.sources, "SOURCES", "data"),
        sources.premature_rows(registers.claims, "CLAIMS", "digest"),
        sources.source_findings(registers.sources, held, scope, graph),
        claims.claim_findings(registers.claims, registers.sources, held, graph),
        vocabulary.vocabulary_findings(registers.vocabulary, controlled),
        feasibility.feasibility_findings(projects, registers.probes, held, scope),
    ])


def named_files(projects: DataFrame, registers: Registers) -> DataFrame:
    """(project_id, rel_path) of every file a rule asks for: registers, records, and what register rows name."""
    fixed_names = sorted({*fixed.REGISTER_NEEDED_AT, *fixed.APPROVAL_BOUND[1:], fixed.BINDING_FILE, fixed.REVIEW_FILE,
                          fixed.APPROVAL_FILE, fixed.POLICY_FILE})
    always = projects.select("project_id", F.explode(F.array(*[F.lit(n) for n in fixed_names])).alias("rel_path"))
    rows = [r.select("project_id", held_path(F.col("local_path")).alias("rel_path"))
            for r in (registers.sources, registers.probes)]
    return always.unionByName(rows[0]).unionByName(rows[1]).filter("rel_path <> ''").distinct()


def evaluate(spark: SparkSession, root: str, projects: DataFrame, release: Release,
             rules: approval.ApprovalRules) -> tuple[DataFrame, DataFrame]:
    """(projects with their contract, findings) for ``projects``: project_id, requested, through."""
    configure(spark)
    order = F.lit(None).cast("int")
    for stage in fixed.STAGES:
        order = F.when(F.col("through") == stage, stage_order(stage)).otherwise(order)
    asked = projects.withColumn("through_ord", order).drop("through")
    names = (fixed.BINDING_FILE, fixed.REVIEW_FILE, fixed.APPROVAL_FILE, fixed.POLICY_FILE)
    texts = written(scan_texts(spark, root, f"{{{','.join(names)}}}").filter(F.col("rel_path").isin(*names)))[0]
    bindings = project_records(texts, fixed.BINDING_FILE)
    bound = written(binding.resolved(asked, bindings).drop("v"))[0].withColumn(
        "v", F.try_parse_json("value"))
    known = bound.select("project_id", "contract", "through_ord")
    registers, heads = read_registers(spark, root, known)
    held = written(scan_held(spark, root, named=named_files(known, registers)))[0]
    heads = written(heads)[0]
    refused = heads.filter("rule = 'header_differs'").select("project_id", "subject_id")

    released = cat.catalogue_findings(release.catalogue, release.instruments, release.roots,
                                      release.observed)
    released, seen = written(released, F.count("*").alias("n"))
    # a catalogue with errors fails every project and leaves the bindings unchecked
    broken = apply_rules(known, "MANIFEST", [
        Rule("catalogue_invalid", F.lit(seen["n"] > 0), F.lit(seen["n"]))])
    bound_ok = bound if seen["n"] == 0 else bound.limit(0)

    records = {name: project_records(texts, name) for name in
               (fixed.REVIEW_FILE, fixed.APPROVAL_FILE, fixed.POLICY_FILE)}
    reviews = review.parsed(known, records[fixed.REVIEW_FILE])
    digests = approval.binding_digests(registers.decisions, held)
    judged = approval.parsed(known, records[fixed.APPROVAL_FILE], records[fixed.POLICY_FILE],
                             reviews, registers.decisions, digests, held, rules)
    present = dict(zip(("decisions.csv", "sources.csv", "claims.csv", "vocabulary.csv",
                        "feasibility.csv"), registers))
    findings = union_all([
        released, broken, binding.resolution_findings(bound),
        binding.instrument_findings(bound_ok, release.instruments,
                                    cat.recognised_hashes(release.catalogue), release.observed),
        heads, presence_findings(known, present, refused, held),
        register_findings(known, registers, held),
        review.review_findings(known, records[fixed.REVIEW_FILE], registers.decisions),
        approval.approval_findings(judged, rules),
        drafts.draft_findings(known, scan_drafts(spark, root), registers.claims),
    ])
    return known, findings
