"""Claim registers: identity, the source cited, and independent corroboration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.routes import usable_url
from auditloom.functions.text import blank, empty_under, strip, unusable
from auditloom.operators import derivation
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import last_rows, repeats, with_columns
from auditloom.operators.sources import prepared as prepared_sources
from auditloom.session import written

ARM = "CLAIMS"


def source_attributes(sources: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One row per source: what its last row says of tier, status, second source and reach."""
    rows = prepared_sources(sources, held).filter("sid <> ''").select(
        "project_id", "row_no", "sid", "tier", "status", "second",
        (usable_url(F.col("url")) | F.col("file_sha256").isNotNull()).alias("reachable"))
    return last_rows(rows, ["project_id", "sid"]).drop("row_no")


def prepared(claims: DataFrame) -> DataFrame:
    material = F.when(F.col("contract") == "v0.1", F.col("load_bearing")).otherwise(
        F.col("material_to_conclusion"))
    return with_columns(claims, fixed.CLAIM_COLUMNS_V03 + ["load_bearing"]).withColumns({
        "cid": strip(F.col("claim_id")), "sid": strip(F.col("source_id")),
        "cor": strip(F.col("corroborating_source_id")),
        "material": F.lower(strip(material)) == "yes"})


def cited(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each claim with the attributes of its source, if registered.

    A left join against one row per source: a source cited by a large share of all claims is split
    by the adaptive skew join.
    """
    return rows.join(attributes.withColumn("registered", F.lit(True)), ["project_id", "sid"], "left")


def backed(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Add the attributes of the corroborating source, by the same kind of join."""
    backing = attributes.select("project_id", F.col("sid").alias("cor"),
                                F.col("tier").alias("cor_tier"), F.col("status").alias("cor_status"),
                                F.col("reachable").alias("cor_reachable"),
                                F.lit(True).alias("cor_registered"))
    return rows.join(backing, ["project_id", "cor"], "left")


def needs_corroboration():
    return (F.col("registered") & F.col("material") & F.col("tier").isin(fixed.INTERESTED_TIERS))


def corroborating_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (source, corroborator) pairs the independence test has to look at."""
    return rows.filter((F.col("contract") == "v0.3") & needs_corroboration() & ~blank(F.col("cor"))
                       & F.col("cor_registered") & (F.col("cor") != F.col("sid"))
                       ).select("project_id", "sid", F.col("cor").alias("other")).distinct()


def _rules() -> list[Rule]:
    v03 = F.col("contract") == "v0.3"
    known = F.coalesce("registered", F.lit(False))
    needs = v03 & needs_corroboration()
    none_named = needs & blank(F.col("cor"))
    unregistered = needs & ~none_named & F.col("cor_registered").isNull()
    own = needs & ~none_named & ~unregistered & (F.col("cor") == F.col("sid"))
    open_pair = needs & ~none_named & ~unregistered & ~own
    return [
        Rule("id_unusable", v03 & F.col("bad_id"), F.col("cid")),
        Rule("text_unusable", v03 & F.col("bad_text")),
        Rule("cites_nothing", F.col("sid") == ""),
        Rule("cites_unregistered", (F.col("sid") != "") & ~known, F.col("sid")),
        Rule("uncertainty_empty", known & F.col("no_uncertainty")),
        Rule("source_not_obtained", v03 & known & (F.col("status") == fixed.NOT_RETRIEVED),
             F.col("sid")),
        Rule("second_source_missing", ~v03 & needs_corroboration() & blank(F.col("second")),
             F.col("sid")),
        Rule("corroboration_missing", none_named, F.col("sid")),
        Rule("corroborator_unregistered", unregistered, F.col("cor")),
        Rule("corroborated_by_itself", own, F.col("sid")),
        Rule("corroborator_not_obtained", open_pair & (F.col("cor_status") == fixed.NOT_RETRIEVED),
             F.col("cor")),
        Rule("corroborator_interested", open_pair & F.col("cor_tier").isin(fixed.INTERESTED_TIERS),
             F.col("cor")),
        Rule("corroborator_unreachable", open_pair & ~F.col("cor_reachable"), F.col("cor")),
        Rule("corroborator_not_independent", open_pair & F.col("relation").isNotNull(),
             F.concat(F.concat_ws(" ", "relation", "cor", "shared"), F.lit(": "), "route")),
    ]


def claim_counts(rows: DataFrame) -> DataFrame:
    """Per project: claims, and claims material to the conclusion that cite a registered source."""
    return rows.groupBy("project_id").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("registered") & F.col("material")).alias("material"))


def claim_findings(claims: DataFrame, sources: DataFrame, held: DataFrame | None = None,
                   graph: derivation.Forest | None = None) -> DataFrame:
    """All claim rules, for the projects that have both claims and sources.

    Claims meet their sources once; the joined rows are landed, since pairs, counts, repeats and
    rules all read them. Of the texts only the tests on them are landed. Defects and repeated ids are
    landed too: where they are few, the claims meet them without being shuffled.
    """
    with_sources = sources.select("project_id").distinct()
    attributes = source_attributes(sources, held)
    base = prepared(claims.join(with_sources, "project_id", "left_semi"))
    tests = [unusable(F.col("cid")).alias("bad_id"), unusable(F.col("claim_text")).alias("bad_text"),
             empty_under(F.col("contract"), F.col("uncertainty")).alias("no_uncertainty")]
    base = base.select("project_id", "row_no", "contract", "cid", "sid", "cor", "material", *tests)
    rows, _ = written(backed(cited(base, attributes), attributes))
    if graph is None:
        judged = rows.withColumns({"relation": F.lit(None).cast("string"),
                                   "shared": F.lit(None).cast("string"),
                                   "route": F.lit(None).cast("string")})
    else:
        defects, _ = written(derivation.with_routes(
            written(derivation.independence_defects(corroborating_pairs(rows), graph))[0], graph))
        judged = rows.join(defects.withColumnRenamed("other", "cor"),
                           ["project_id", "sid", "cor"], "left")
    folded = rows.withColumn("key", F.lower("cid"))
    again = repeats(folded.select("project_id", "row_no", "cid", "key", "contract", "bad_id"),
                    ["project_id", "key"], among=(F.col("contract") == "v0.3") & ~F.col("bad_id"), landed=True)
    note = F.format_string("claims=%d material=%d", "claims", "material")
    return union_all([
        apply_rules(judged, ARM, _rules(), F.col("cid"), F.col("row_no")),
        apply_rules(again, ARM, [Rule("id_used_twice", F.lit(True))], F.col("cid"),
                    F.col("row_no")),
        apply_rules(claim_counts(rows), ARM, [Rule("counts", F.lit(True), note, "note")]),
    ])
