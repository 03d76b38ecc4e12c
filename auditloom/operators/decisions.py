"""Decision registers: required rows present, filled, dated and attributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.actors import actor_identity
from auditloom.functions.digests import decision_row_digest
from auditloom.functions.text import alternatives, blank, empty_under, iso_date, strip
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import contract_decisions, first_rows, projects_of, repeats

ARM = "DECISIONS"


def keyed(decisions: DataFrame) -> DataFrame:
    """Add ``did``, the folded decision id every consumer compares by."""
    return decisions.withColumn("did", F.upper(strip(F.col("decision_id"))))


def first_decisions(decisions: DataFrame) -> DataFrame:
    """The row that counts for each (project, decision id): the first one logged."""
    return first_rows(keyed(decisions), ["project_id", "did"])


def required_decisions(projects: DataFrame) -> DataFrame:
    """The decisions each project owes by its contract up to its stage."""
    dim = contract_decisions(projects.sparkSession).withColumnRenamed("decision_id", "did")
    owed = dim.withColumnRenamed("contract", "of_contract")
    return projects.join(
        owed, (F.col("contract") == F.col("of_contract"))
        & (F.col("stage_ord") <= F.col("through_ord"))).drop("of_contract")


def missing_decisions(required: DataFrame, first: DataFrame) -> DataFrame:
    return required.join(first, ["project_id", "did"], "left_anti")


def extra_decisions(required: DataFrame, first: DataFrame) -> DataFrame:
    return first.filter("did <> ''").join(required, ["project_id", "did"], "left_anti")


def _row_rules() -> tuple[list[Rule], Column]:
    contract = F.col("contract")
    v03 = contract == "v0.3"
    tokens = alternatives(F.col("alternatives"))
    none_left = (F.size(tokens) == 0) | (~v03 & F.forall(tokens, blank))
    no_date = blank(F.col("decided_date"))
    rules = [
        Rule("chosen_empty", empty_under(contract, F.col("chosen")), F.col("chosen")),
        Rule("rationale_empty", empty_under(contract, F.col("rationale")), F.col("rationale")),
        Rule("no_alternative", none_left, F.col("alternatives")),
        Rule("date_missing", no_date),
        Rule("date_not_iso", contract.isin("v0.2", "v0.3") & ~no_date
             & iso_date(F.col("decided_date")).isNull(), F.col("decided_date")),
        Rule("actor_not_comparable", v03 & actor_identity(F.col("decided_by")).isNull(),
             F.col("decided_by")),
    ]
    unreadable = F.filter(tokens, lambda t: v03 & empty_under(contract, t))
    per_token = F.transform(unreadable, lambda t: F.struct(
        F.lit("alternative_unusable").alias("rule"), F.lit("error").alias("severity"),
        strip(t).alias("detail")))
    return rules, per_token


def decision_findings(decisions: DataFrame) -> DataFrame:
    """All decision rules for every project that logged at least one row.

    The register is reduced once to a row per (project, id). What a project owes and what it logged
    then meet in one full join, and every rule reads the joined row.
    """
    rows = keyed(decisions)
    first = first_rows(rows, ["project_id", "did"])
    required = required_decisions(projects_of(first)).drop("through_ord", "question").withColumn("owed", F.lit(True))
    logged = first.drop("contract", "through_ord", "question", "stage").withColumn("logged", F.lit(True))
    met = required.join(logged, ["project_id", "did"], "full")
    rules, per_token = _row_rules()
    both = F.col("owed") & F.col("logged")
    did, none = F.col("did"), F.array().cast("array<struct<rule:string,severity:string,detail:string>>")
    owed = [Rule("not_logged", F.col("logged").isNull(), F.col("stage")),
            Rule("extra_decision", F.col("owed").isNull() & (did != ""), severity="note"),
            *[rule._replace(when=both & rule.when) for rule in rules]]
    counts = met.groupBy("project_id").agg(F.count("owed").alias("required"), F.count("logged").alias("n"))
    return union_all([
        apply_rules(repeats(rows, ["project_id", "did"]), ARM,
                    [Rule("logged_twice", F.lit(True))], did, F.col("row_no")),
        apply_rules(met, ARM, owed, did, F.col("row_no"),
                    more=F.when(both, F.coalesce(per_token, none)).otherwise(none)),
        apply_rules(counts, ARM, [Rule("decision_counts", F.lit(True), F.format_string(
            "required=%d logged=%d", "required", "n"), "note")]),
    ])


def latest_scope_dates(decisions: DataFrame) -> DataFrame:
    """Per project, the last valid date over its scope rows, repeats included."""
    date = iso_date(F.col("decided_date"))
    return (keyed(decisions)
            .filter(F.col("did").isin(fixed.SCOPE_IDS) & ~blank(F.col("decided_date")))
            .groupBy("project_id").agg(F.max(date).alias("latest_scope"))
            .filter("latest_scope IS NOT NULL"))


def earliest_scope_dates(decisions: DataFrame) -> DataFrame:
    """The boundary of the first gate version: the lexically smallest raw date over S1 to S5."""
    raw = strip(F.col("decided_date"))
    return (keyed(decisions)
            .filter(F.col("did").isin(fixed.SCOPE_IDS[:5]) & ~blank(F.col("decided_date")))
            .groupBy("project_id").agg(F.min(raw).alias("earliest_scope")))


def decision_digests(decisions: DataFrame) -> DataFrame:
    """The first row of every decision id with the SHA-256 of its nine fields."""
    return first_decisions(decisions).withColumn("digest", decision_row_digest())


def scope_digests(decisions: DataFrame) -> DataFrame:
    """Per project, the digest over its ten question and scope rows in fixed order.

    Null where any decision id (a blank one too) is repeated or one of the ten is missing.
    """
    rows = keyed(decisions).withColumn("digest", decision_row_digest())
    per_id = rows.groupBy("project_id", "did").agg(
        F.count("*").alias("n"), F.min("digest").alias("digest"))
    place = F.array_position(F.array(*[F.lit(d) for d in fixed.QUESTION_SCOPE_IDS]), F.col("did"))
    line = F.struct(place.alias("place"),
                    F.concat("did", F.lit(":"), "digest", F.lit("\n")).alias("line"))
    # At most one line per listed id is kept, so the list never exceeds ten entries per project
    # once repeats are ruled out by max_n.
    return (per_id.groupBy("project_id")
            .agg(F.max("n").alias("max_n"), F.count_if(place > 0).alias("found"),
                 F.collect_list(F.when(place > 0, line)).alias("lines"))
            .select("project_id", F.when(
                (F.col("max_n") == 1) & (F.col("found") == len(fixed.QUESTION_SCOPE_IDS)),
                F.sha2(F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), ""),
                       256)).alias("scope_digest")))


def review_digest_block(decisions: DataFrame) -> DataFrame:
    """Per project, the JSON digest block a scope reviewer records; null when a row is missing."""
    rows = decision_digests(decisions).filter(F.col("did").isin(fixed.REVIEW_DECISIONS))
    order = F.array(*[F.lit(d) for d in fixed.REVIEW_DECISIONS])
    return (rows.groupBy("project_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("did", "digest"))).alias("found"))
            .select("project_id", F.when(
                F.size("found") == len(fixed.REVIEW_DECISIONS),
                F.to_json(F.struct(F.map_from_arrays(order, F.transform(
                    order, lambda d: F.col("found")[d])).alias("reviewed_decisions")))
            ).alias("block")))
