"""Scope approvals: who may open the data stage, on what record, bound to which bytes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.actors import actor_identity, is_recorded_authority, name_tokens
from auditloom.functions.routes import reference_defect
from auditloom.functions.text import blank, iso_date, let, sha256_form, strip, unusable
from auditloom.operators.decisions import keyed, scope_digests
from auditloom.operators.findings import Rule, apply_rules
from auditloom.operators.registers import stage_order
from auditloom.sources import records as rec

ARM = "SCOPE_APPROVAL"


class ApprovalRules(NamedTuple):
    """Who is recorded as the approving authority, and the literal of the automatic approver."""

    authorities: list[str]
    automatic_approver: str


def binding_digests(decisions: DataFrame, held: DataFrame) -> DataFrame:
    """(project_id, name, digest) of the three things an approval is bound to."""
    scope = scope_digests(decisions).select(
        "project_id", F.lit(fixed.APPROVAL_SCOPE_BINDING).alias("name"),
        F.col("scope_digest").alias("digest"))
    files = held.filter(F.col("rel_path").isin(fixed.APPROVAL_BOUND[1:])).select(
        "project_id", F.col("rel_path").alias("name"), F.col("file_sha256").alias("digest"))
    return scope.unionByName(files).filter("digest IS NOT NULL")


def digest_block(digests: DataFrame) -> DataFrame:
    """(project_id, block): the JSON block an approval records; null while one part is missing."""
    order = F.array(*[F.lit(n) for n in fixed.APPROVAL_BOUND])
    found = digests.groupBy("project_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "digest"))).alias("found"))
    return found.select("project_id", F.when(
        F.size("found") == len(fixed.APPROVAL_BOUND),
        F.to_json(F.struct(F.map_from_arrays(order, F.transform(
            order, lambda n: F.col("found")[n])).alias("bound_files")))).alias("block"))


def _policy_defect(permission: str) -> Column:
    """First reason the policy, read by ``_read``, does not grant ``permission``."""
    state, granted = F.col("policy_state"), F.col("granted")
    return (F.when(state == "missing", "policy_missing")
            .when(state == "malformed", "policy_malformed")
            .when(state == "not_object", "policy_not_object")
            .when(~F.col("policy_type").eqNullSafe(fixed.POLICY_RECORD_TYPE), "policy_type_invalid")
            .when(~F.col("policy_schema").eqNullSafe(fixed.POLICY_SCHEMA_VERSION)
                  | ~F.col("policy_contract").eqNullSafe(fixed.POLICY_CONTRACT),
                  "policy_version_invalid")
            .when(~F.col("policy_owned"), "policy_owner_invalid")
            .when(granted.isNull() | ~F.exists(granted, lambda g: g.eqNullSafe(permission)), "not_delegated"))


def _families(policy: Column, key: str) -> Column:
    """array<array<string>>: name tokens of a family list; null where the list is not valid."""
    return let(rec.strings(rec.part(policy, key)), lambda names: F.when(
        F.forall(names, lambda n: ~unusable(n)), F.transform(names, name_tokens)))


def _read(rows: DataFrame, rules: ApprovalRules) -> DataFrame:
    """Add what the rules look at, each part of a record read into a column of its own once.

    Several rules test each part; as expressions inside them the parts would be read for every test.
    """
    v, p = F.col("v"), F.col("p")
    held = rows.withColumns({
        "policy_type": rec.string_part(p, "record_type"), "policy_schema": rec.string_part(p, "schema_version"),
        "policy_contract": rec.string_part(p, "contract"), "policy_owner": rec.string_part(p, "policy_owner"),
        "granted": F.transform(rec.items(rec.part(p, "delegated_permissions")), rec.as_string),
        "allowed": _families(p, "allowed_model_families"), "denied": _families(p, "excluded_model_families"),
        "human": is_recorded_authority(F.col("approved_by"), rules.authorities),
        "raw_date": rec.string_part(v, "approval_date"),
        "decision": F.lower(strip(rec.string_part(v, "decision"))),
        "reference": rec.string_part(v, "approval_reference"),
        "bound": rec.entries(v, "bound_files"),
        "accepted_part": rec.part(v, "accepted_checks"),
        "policy_digest": rec.string_part(v, "authority_policy_sha256")})
    held = held.withColumns({
        "policy_owned": is_recorded_authority(F.col("policy_owner"), rules.authorities),
        "approved": iso_date(F.col("raw_date")), "reference_defect": reference_defect(F.col("reference")),
        "accepted": rec.strings(F.col("accepted_part"))})
    return held.withColumn("named", F.transform("accepted", strip))


def _matches(families: Column, tokens: Column) -> Column:
    """Some family's tokens all occur among the tokens of the approver's model name."""
    return F.exists(families, lambda f: (F.size(f) > 0) & F.forall(
        f, lambda t: F.array_contains(tokens, t)))


def parsed(projects: DataFrame, approvals: DataFrame, policies: DataFrame, reviews: DataFrame,
           decisions: DataFrame, digests: DataFrame, held: DataFrame,
           rules: ApprovalRules) -> DataFrame:
    """One row per v0.3 project at stage 'data' or later with all an approval is judged by.

    ``reviews`` come from ``review.parsed``; ``approvals`` and ``policies`` have project_id, value;
    ``digests`` from ``binding_digests``; ``held`` is the file listing.
    """
    due = projects.filter((F.col("contract") == "v0.3")
                          & (F.col("through_ord") >= stage_order("data")))
    rows = (due.join(approvals, "project_id", "left")
            .join(policies.withColumnRenamed("value", "policy_value"), "project_id", "left")
            .join(reviews.select("project_id", F.col("state").alias("review_state"),
                                 F.col("reviewer_key"), F.col("review_date"), "exceptional"),
                  "project_id", "left")
            .join(held.filter(F.col("rel_path") == fixed.POLICY_FILE).select(
                "project_id", F.col("file_sha256").alias("policy_sha256")), "project_id", "left")
            .join(digests.groupBy("project_id").agg(F.map_from_entries(
                F.collect_list(F.struct("name", "digest"))).alias("current")),
                "project_id", "left"))
    rows = rows.withColumns({"v": rec.record(F.col("value")), "p": rec.record(F.col("policy_value"))})
    rows = rows.withColumns({"state": rec.state(F.col("value"), F.col("v")),
                             "policy_state": rec.state(F.col("policy_value"), F.col("p"))})
    approver = F.coalesce(rec.string_part(F.col("v"), "approved_by"), F.lit(""))
    rows = rows.withColumns({"approved_by": approver, "approver": actor_identity(approver)})
    makers = (keyed(decisions).filter(F.col("did").isin(fixed.QUESTION_SCOPE_IDS))
              # behind an explode, so that the test for null does not take every actor apart once more
              .select("project_id", F.explode(F.array(actor_identity(F.col("decided_by")))).alias("approver"))
              .filter("approver IS NOT NULL").distinct().withColumn("made_scope", F.lit(True)))
    return rows.join(makers, ["project_id", "approver"], "left")


def _approver_defect(rules: ApprovalRules) -> tuple[Column, Column, Column]:
    """(human, automatic form, first defect of a policy-based approver), after ``_read``."""
    human = F.col("human")
    automatic = strip(F.col("approved_by")) == rules.automatic_approver
    exceptions = F.coalesce(F.size("exceptional") > 0, F.lit(False))
    tokens = F.split(F.col("approver")["model"], " ")
    allowed, denied = F.col("allowed"), F.col("denied")
    delegated = F.coalesce(
        F.when(exceptions, "exceptions_present"),
        _policy_defect(fixed.DELEGATED_PERMISSION),
        F.when(allowed.isNull() | (F.size(allowed) == 0) | denied.isNull(), "families_invalid")
        .when(F.col("approver").isNull(), "approver_not_comparable")
        .when(_matches(denied, tokens), "family_excluded")
        .when(~_matches(allowed, tokens), "family_not_allowed")
        .when(F.col("review_state") == "missing", "review_missing")
        .when(F.col("review_state") != "ok", "review_unreadable")
        .when(F.col("reviewer_key") == F.col("approver"), "approver_is_reviewer")
        .when(F.col("made_scope"), "approver_made_scope"))
    clean_open = F.coalesce(F.when(exceptions, "exceptions_present"),
                            _policy_defect(fixed.AUTOMATIC_PERMISSION))
    defect = F.when(automatic, clean_open).when(~human, delegated)
    return human, automatic, defect


def approval_findings(rows: DataFrame, rules: ApprovalRules) -> DataFrame:
    """All rules of the approval record. ``rows`` come from ``parsed``."""
    v, ok = F.col("v"), F.col("state") == "ok"
    human, automatic, defect = _approver_defect(rules)
    rows = _read(rows, rules).withColumns({"approver_defect": defect, "by_policy": (automatic | ~human)})
    raw_date, approved, decision = F.col("raw_date"), F.col("approved"), F.col("decision")
    dated = raw_date.isNotNull() & ~blank(raw_date)
    decided = decision.isin(fixed.APPROVAL_DECISIONS)
    reference, bound = F.col("reference"), F.col("bound")
    wanted = F.array(*[F.lit(n) for n in fixed.APPROVAL_BOUND])
    complete = (F.size(bound) == len(fixed.APPROVAL_BOUND)) & (
        F.size(F.array_except(wanted, F.map_keys(bound))) == 0)
    accepted, named = F.col("accepted"), F.col("named")
    unknown = F.array_sort(F.array_except(named, F.array(*[F.lit(c) for c in
                                                           fixed.REVIEW_CHECKS])))
    policy_digest = F.col("policy_digest")
    granted = F.col("by_policy") & F.col("approver_defect").isNull()
    differs = (F.size(F.array_except(named, F.col("exceptional")))
               + F.size(F.array_except(F.col("exceptional"), named))) > 0
    tests = [
        Rule("record_missing", F.col("state") == "missing"),
        Rule("record_malformed", F.col("state") == "malformed"),
        Rule("record_not_object", F.col("state") == "not_object"),
        Rule("type_invalid", ok & ~rec.string_part(v, "record_type")
             .eqNullSafe(fixed.APPROVAL_RECORD_TYPE)),
        Rule("schema_invalid", ok & ~rec.string_part(v, "schema_version")
             .eqNullSafe(fixed.APPROVAL_SCHEMA_VERSION)),
        Rule("contract_invalid", ok & (F.lower(strip(rec.string_part(v, "contract"))) != "v0.3")),
        Rule("approver_refused", ok & F.col("approver_defect").isNotNull(),
             F.col("approver_defect")),
        Rule("date_missing", ok & ~dated),
        Rule("date_not_iso", ok & dated & approved.isNull(), raw_date),
        Rule("decision_invalid", ok & ~decided, decision),
        Rule("not_proceeding", ok & decided & (decision != fixed.APPROVAL_OPENS), decision),
        Rule("reference_not_string", ok & reference.isNull()),
        Rule("reference_untraceable", ok & reference.isNotNull()
             & F.col("reference_defect").isNotNull(), F.col("reference_defect")),
        Rule("bound_not_object", ok & bound.isNull()),
        Rule("bound_set_differs", ok & bound.isNotNull() & ~complete,
             F.array_join(F.array_sort(F.map_keys(bound)), ", ")),
        Rule("policy_not_bound", ok & granted & ~F.coalesce(
            sha256_form(policy_digest) & (policy_digest == F.col("policy_sha256")), F.lit(False))),
        Rule("accepted_not_list", ok & accepted.isNull()),
        Rule("accepted_unknown", ok & (F.size(unknown) > 0), F.array_join(unknown, ", ")),
        Rule("accepted_repeated", ok & (F.size(F.array_distinct(named)) < F.size(named))),
        Rule("accepted_set_differs", ok & F.col("exceptional").isNotNull() & differs,
             F.array_join(F.col("exceptional"), ", ")),
        Rule("approval_before_review", ok & (approved < F.col("review_date")), approved),
        Rule("recorded", ok, F.format_string("decision=%s accepted=%d", decision, F.coalesce(
            F.size(rec.items(F.col("accepted_part"))), F.lit(0))), "note"),
    ]

    def bound_defect(name: Column) -> Column:
        current = F.try_element_at(F.col("current"), name)
        rule = let(rec.as_string(F.try_element_at(bound, name)), lambda recorded: (
            F.when(recorded.isNull() | ~sha256_form(strip(recorded)), "bound_digest_form")
            .when(current.isNull(), "bound_unresolved")
            .when(strip(recorded) != current, "bound_stale")))
        return F.struct(rule.alias("rule"), F.lit("error").alias("severity"), name.alias("detail"))

    each = F.filter(F.transform(wanted, bound_defect), lambda d: d["rule"].isNotNull())
    none = F.array().cast("array<struct<rule:string,severity:string,detail:string>>")
    return apply_rules(rows, ARM, tests,
                       more=F.when(ok & F.coalesce(complete, F.lit(False)), each).otherwise(none))
