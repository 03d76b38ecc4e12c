"""Scope coherence reviews: record shape, reviewer independence, digests and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.actors import actor_identity
from auditloom.functions.text import blank, iso_date, let, sha256_form, strip, unusable
from auditloom.operators.decisions import decision_digests
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import stage_order
from auditloom.sources import records as rec

ARM = "SCOPE_REVIEW"


def _listed(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _check(entries: Column, name: Column) -> Column:
    """struct of one required check: its result, note and any in-record acceptance.

    The fields are read from the record once, since several tests look at each.
    """
    def read(item: Column) -> Column:
        return F.struct(rec.is_object(item).alias("is_object"),
                        F.lower(strip(rec.string_part(item, "result"))).alias("result"),
                        rec.string_part(item, "note").alias("note"),
                        rec.string_part(item, "exception_accepted_by").alias("accepted"))

    def judged(fields: Column) -> Column:
        is_object, result, note, accepted = (fields[n] for n in ("is_object", "result", "note", "accepted"))
        return F.struct(
            name.alias("check"), is_object.alias("is_object"),
            (is_object & ~result.isin(fixed.REVIEW_RESULTS)).alias("bad_result"),
            (is_object & (note.isNull() | unusable(note))).alias("no_note"),
            (is_object & result.isin("fail", "unresolved")).alias("exceptional"),
            (is_object & accepted.isNotNull() & ~blank(accepted)).alias("accepted"))

    return let(let(F.try_element_at(entries, name), read), judged)


def parsed(projects: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per v0.3 project at stage 'data' or later, with the fields of its review.

    ``reviews`` has project_id and value (the JSON text). ``exceptional`` is null where the record
    is unreadable or has no usable checks.
    """
    due = projects.filter((F.col("contract") == "v0.3")
                          & (F.col("through_ord") >= stage_order("data")))
    rows = due.join(reviews, "project_id", "left")
    rows = rows.withColumn("v", rec.record(F.col("value")))
    v, checks, reviewer = F.col("v"), F.col("given_checks"), F.col("reviewer")
    rows = rows.withColumns({"state": rec.state(F.col("value"), v), "given_checks": rec.entries(v, "checks"),
                             "reviewer": rec.string_part(v, "reviewer")})
    required = _listed(sorted(fixed.REVIEW_CHECKS))
    rows = rows.select(
        "project_id", "state", rec.string_part(v, "record_type").alias("record_type"),
        rec.string_part(v, "schema_version").alias("schema_version"),
        F.lower(strip(rec.string_part(v, "contract"))).alias("record_contract"),
        "reviewer", actor_identity(reviewer).alias("reviewer_key"),
        rec.string_part(v, "review_date").alias("raw_date"),
        rec.entries(v, "reviewed_decisions").alias("reviewed"),
        F.map_keys(checks).alias("check_names"),
        let(checks, lambda c: F.when(c.isNotNull(), F.transform(required, lambda n: _check(c, n))))
        .alias("checks"))
    exceptional = F.transform(F.filter("checks", lambda c: c["exceptional"]), lambda c: c["check"])
    return rows.withColumns({"review_date": iso_date(F.col("raw_date")),
                             "exceptional": exceptional})


def _differs(found: Column, wanted: Column) -> Column:
    return (F.size(F.array_except(found, wanted)) > 0) | (F.size(F.array_except(wanted, found)) > 0)


def record_findings(reviews: DataFrame) -> DataFrame:
    """Rules of the record itself. ``reviews`` come from ``parsed``."""
    ok, dated = F.col("state") == "ok", F.col("raw_date").isNotNull() & ~blank(F.col("raw_date"))
    ids = F.transform(F.map_keys("reviewed"), lambda k: F.upper(strip(k)))
    has_checks = ok & F.col("checks").isNotNull()
    rules = [
        Rule("record_missing", F.col("state") == "missing"),
        Rule("record_malformed", F.col("state") == "malformed"),
        Rule("record_not_object", F.col("state") == "not_object"),
        Rule("type_invalid", ok & ~F.col("record_type").eqNullSafe(fixed.REVIEW_RECORD_TYPE)),
        Rule("schema_invalid",
             ok & ~F.col("schema_version").eqNullSafe(fixed.REVIEW_SCHEMA_VERSION)),
        Rule("contract_invalid", ok & (F.col("record_contract") != "v0.3")),
        Rule("reviewer_not_comparable", ok & F.col("reviewer_key").isNull()),
        Rule("date_missing", ok & ~dated),
        Rule("date_not_iso", ok & dated & F.col("review_date").isNull(), F.col("raw_date")),
        Rule("reviewed_not_object", ok & F.col("reviewed").isNull()),
        Rule("reviewed_ids_differ", ok & _differs(ids, _listed(fixed.REVIEW_DECISIONS)),
             F.array_join(F.array_sort(ids), ", ")),
        Rule("checks_not_object", ok & F.col("checks").isNull()),
        Rule("checks_differ", has_checks & _differs(F.col("check_names"),
                                                    _listed(fixed.REVIEW_CHECKS))),
        Rule("reviewed", has_checks, F.format_string(
            "exceptional=%d", F.size("exceptional")), "note"),
    ]

    def per_check(rule: str, flag) -> Column:
        return F.transform(F.filter("checks", flag), lambda c: F.struct(
            F.lit(rule).alias("rule"), F.lit("error").alias("severity"), c["check"].alias("detail")))

    each = F.concat(per_check("check_not_object", lambda c: ~c["is_object"]),
                    per_check("check_result_invalid", lambda c: c["bad_result"]),
                    per_check("check_note_empty", lambda c: c["no_note"]),
                    per_check("accepted_in_review", lambda c: c["accepted"]))
    none = F.array().cast("array<struct<rule:string,severity:string,detail:string>>")
    return apply_rules(reviews, ARM, rules, more=F.when(has_checks, each).otherwise(none))


def reviewed_rows(reviews: DataFrame, digests: DataFrame) -> DataFrame:
    """Each reviewed decision beside the row it reviews.

    ``digests`` has project_id, did, digest, decided_by and decided_date of the first rows.
    """
    listed = reviews.filter("reviewed IS NOT NULL").select(
        "project_id", "reviewer_key", "review_date", "reviewed",
        F.explode(_listed(fixed.REVIEW_DECISIONS)).alias("did"))
    named = F.filter(F.map_entries("reviewed"), lambda e: F.upper(strip(e["key"])) == F.col("did"))
    value = F.get(named, F.lit(0))["value"]
    recorded = listed.select(
        "project_id", "reviewer_key", "review_date", "did",
        strip(rec.as_string(value)).alias("recorded"), rec.kind(value).alias("kind")
    ).filter(~F.col("kind").isin("", "VOID"))
    rows = digests.select("project_id", "did", "digest", "decided_date",
                          actor_identity(F.col("decided_by")).alias("maker"))
    return recorded.join(rows, ["project_id", "did"], "left")


def reviewed_row_findings(rows: DataFrame) -> DataFrame:
    logged = F.col("digest").isNotNull()
    formed = logged & (F.col("kind") == "STRING") & sha256_form(F.col("recorded"))
    decided = F.when(~blank(F.col("decided_date")), iso_date(F.col("decided_date")))
    return apply_rules(rows, ARM, [
        Rule("reviewed_not_logged", ~logged),
        Rule("digest_form", logged & ~formed),
        Rule("digest_stale", formed & (F.col("recorded") != F.col("digest")), F.col("digest")),
        Rule("reviewer_is_maker", formed & (F.col("reviewer_key") == F.col("maker"))),
        Rule("review_before_decision", formed & (F.col("review_date") < decided), decided),
    ], F.col("did"))


def review_findings(projects: DataFrame, reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    rows = parsed(projects, reviews)
    digests = decision_digests(decisions).filter(F.col("did").isin(fixed.REVIEW_DECISIONS))
    return union_all([record_findings(rows),
                      reviewed_row_findings(reviewed_rows(rows, digests))])
