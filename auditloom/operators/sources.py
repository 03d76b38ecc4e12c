"""Source registers: identity, custody, locators, dates and derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.routes import held_path, usable_url
from auditloom.functions.text import blank, empty_under, iso_date, strip, unusable
from auditloom.operators import derivation
from auditloom.operators.findings import Rule, apply_rules, union_all
from auditloom.operators.registers import repeats, with_columns
from auditloom.session import written

ARM = "SOURCES"


def prepared(sources: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Stripped keys and the digest of the held file, if the row's path names one."""
    rows = with_columns(sources, fixed.SOURCE_COLUMNS_V03).withColumns({
        "sid": strip(F.col("source_id")), "status": strip(F.col("retrieval_status")),
        "tier": strip(F.col("motive_tier")), "second": strip(F.col("second_source_id"))})
    if held is None:
        return rows.withColumn("file_sha256", F.lit(None).cast("string"))
    files = held.select(F.col("project_id").alias("_p"), "rel_path", "file_sha256")
    return rows.join(files, (F.col("project_id") == F.col("_p"))
                     & (held_path(F.col("local_path")) == F.col("rel_path")), "left"
                     ).drop("_p", "rel_path")


def _custody():
    retrieved = F.col("status") == fixed.RETRIEVED
    no_path = retrieved & blank(F.col("local_path"))
    not_held = retrieved & ~no_path & F.col("file_sha256").isNull()
    checked = retrieved & F.col("file_sha256").isNotNull() & ~no_path
    unhashed = checked & blank(F.col("sha256"))
    matches = checked & ~unhashed & (strip(F.col("sha256")) == F.col("file_sha256"))
    mismatch = checked & ~unhashed & ~matches
    return no_path, not_held, unhashed, matches, mismatch


def _row_rules(scope: str) -> list[Rule]:
    contract, v03 = F.col("contract"), F.col("contract") == "v0.3"
    named = F.col("sid") != ""
    no_path, not_held, unhashed, _, mismatch = _custody()
    url, path = strip(F.col("url")), strip(F.col("local_path"))
    url_ok, path_held = usable_url(F.col("url")), F.col("file_sha256").isNotNull()
    unobtained = F.col("status") == fixed.NOT_RETRIEVED
    dated = named & ~no_path & ~not_held
    no_date = blank(F.col("accessed_date"))
    accessed = iso_date(F.col("accessed_date"))
    rules = [
        Rule("id_missing", ~named),
        Rule("tier_invalid", named & ~F.col("tier").isin(fixed.TIERS), F.col("tier")),
        Rule("id_unusable", v03 & named & unusable(F.col("sid"))),
        Rule("role_empty", v03 & named & unusable(F.col("source_role"))),
        Rule("title_empty", v03 & named & unusable(F.col("title"))),
        Rule("publisher_empty", v03 & named & unusable(F.col("publisher"))),
        Rule("url_unusable", v03 & named & (url != "") & ~url_ok, url),
        Rule("path_not_held", v03 & named & (path != "") & ~path_held
             & (F.col("status") != fixed.RETRIEVED), path),
        Rule("locator_missing", v03 & named & ~url_ok & ~path_held),
        Rule("retrieved_without_path", named & no_path),
        Rule("retrieved_not_held", named & not_held, path),
        Rule("held_not_hashed", named & unhashed, F.col("file_sha256")),
        Rule("hash_mismatch", named & mismatch, F.col("file_sha256")),
        Rule("unretrieved_without_reason",
             named & unobtained & empty_under(contract, F.col("notes"))),
        Rule("date_missing", dated & no_date),
    ]
    if scope == "earliest_lexical":
        return rules + [Rule("date_before_scope", dated & ~no_date & (
            strip(F.col("accessed_date")) < F.col("earliest_scope")), F.col("accessed_date"))]
    return rules + [
        Rule("date_not_iso", dated & ~no_date & contract.isin("v0.2", "v0.3") & accessed.isNull(),
             F.col("accessed_date")),
        Rule("date_before_scope", dated & ~no_date & (accessed < F.col("latest_scope")), accessed),
    ]


def source_row_findings(rows: DataFrame, scope_dates: DataFrame | None = None,
                        scope: str = "latest") -> DataFrame:
    """Rules one source row decides alone. ``rows`` come from ``prepared``.

    ``scope='earliest_lexical'`` is the date rule of the first gate version.
    """
    column = "earliest_scope" if scope == "earliest_lexical" else "latest_scope"
    if scope_dates is None:
        kind = "string" if scope == "earliest_lexical" else "date"
        rows = rows.withColumn(column, F.lit(None).cast(kind))
    else:
        rows = rows.join(scope_dates.select("project_id", column), "project_id", "left")
    return union_all([
        apply_rules(rows, ARM, _row_rules(scope), F.col("sid"), F.col("row_no")),
        apply_rules(repeats(rows, ["project_id", "sid"], among=F.col("sid") != ""), ARM,
                    [Rule("registered_twice", F.lit(True))], F.col("sid"), F.col("row_no")),
    ])


def source_coverage(rows: DataFrame) -> DataFrame:
    """Per project: distinct sources, held and verified, not retrieved, and its rounded share."""
    _, _, _, matches, _ = _custody()
    named = rows.filter("sid <> ''")
    counts = named.groupBy("project_id").agg(
        F.count_distinct("sid").alias("sources"), F.count_if(matches).alias("held"),
        F.count_if(F.col("status") == fixed.NOT_RETRIEVED).alias("unretrieved"))
    # half to even, as the published percentage rounds
    return counts.withColumn("unretrieved_pct", F.bround(
        100.0 * F.col("unretrieved") / F.col("sources"), 0).cast("bigint"))


def derivation_findings(rows: DataFrame, graph: derivation.Forest) -> DataFrame:
    """The v0.3 rules on origins and second sources.

    Loop and independence findings carry the recorded route, as long as the derivation itself.
    """
    ids = rows.filter("sid <> ''").select("project_id", F.col("sid").alias("id")).distinct()
    v03 = rows.filter(F.col("contract") == "v0.3").select("project_id", "row_no", "sid", "second")
    loops = derivation.loop_paths(graph)
    origins = (v03.join(graph.parents, ["project_id", "sid"]).filter("origin <> ''")
               .join(ids.withColumnRenamed("id", "origin").withColumn("known", F.lit(True)),
                     ["project_id", "origin"], "left")
               .join(loops, ["project_id", "sid"], "left"))
    seconds = v03.filter("second <> ''").join(
        ids.withColumnRenamed("id", "second").withColumn("known", F.lit(True)),
        ["project_id", "second"], "left")
    pairs = seconds.filter("known AND second <> sid").select(
        "project_id", "row_no", "sid", F.col("second").alias("other"))
    defects = derivation.with_routes(written(derivation.independence_defects(pairs, graph))[0], graph)
    return union_all([
        apply_rules(origins, ARM, [
            Rule("origin_unregistered", F.col("known").isNull(), F.col("origin")),
            Rule("derives_from_itself", F.col("origin") == F.col("sid"), F.col("origin")),
            Rule("derivation_loop", F.col("path").isNotNull(), F.col("path")),
        ], F.col("sid"), F.col("row_no")),
        apply_rules(seconds, ARM, [
            Rule("second_unregistered", F.col("known").isNull(), F.col("second")),
            Rule("second_is_itself", F.col("known") & (F.col("second") == F.col("sid"))),
        ], F.col("sid"), F.col("row_no")),
        apply_rules(pairs.join(defects, ["project_id", "sid", "other"]), ARM, [
            Rule("second_not_independent", F.lit(True),
                 F.concat(F.concat_ws(" ", "relation", "other", "shared"), F.lit(": "), "route")),
        ], F.col("sid"), F.col("row_no")),
    ])


def source_findings(sources: DataFrame, held: DataFrame | None = None,
                    scope_dates: DataFrame | None = None,
                    graph: derivation.Forest | None = None) -> DataFrame:
    """All source rules. ``graph`` is needed where any project is checked under v0.3."""
    rows = prepared(sources, held)
    frames = [source_row_findings(rows, scope_dates)]
    if graph is not None:
        frames.append(derivation_findings(rows, graph))
    note = F.format_string("sources=%d held=%d unretrieved=%d pct=%d", "sources", "held",
                           "unretrieved", "unretrieved_pct")
    frames.append(apply_rules(source_coverage(rows), ARM,
                              [Rule("coverage", F.lit(True), note, "note")]))
    return union_all(frames)


def premature_rows(rows: DataFrame, arm: str, before: str) -> DataFrame:
    """One error per project that filled a register before the stage that opens it."""
    counts = rows.groupBy("project_id").agg(F.max("through_ord").alias("through_ord"),
                                            F.count("*").alias("n"))
    early = F.col("through_ord") < fixed.STAGES.index(before)
    return apply_rules(counts, arm, [Rule("filled_too_early", early, F.col("n"))])

