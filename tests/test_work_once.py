"""Rules and texts are worked out once: plans, and the results of the ways that were changed for it."""

import random
import re

from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions import prose
from auditloom.operators import attribution, grounding
from auditloom.operators import drafts as drf
from auditloom.operators import claims as clm
from auditloom.operators import review as rvw
from auditloom.operators import vocabulary as voc
from auditloom.operators.findings import Rule, apply_rules, verdict
from auditloom.operators.registers import repeats
from auditloom.plans import audit
from auditloom.session import configure
from registry.queries import _dealt


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rules_are_compiled_and_tested_once(spark):
    configure(spark)
    rows = spark.createDataFrame([("p", "x1"), ("p", "y"), (None, "x2")], "project_id string, v string")
    found = apply_rules(rows, "ARM", [Rule("has_x", F.col("v").rlike("only_here|x"), F.col("v")),
                                      Rule("null_condition", F.lit(None).cast("boolean")),
                                      Rule("all", F.lit(True), severity="note")], F.col("v"))
    plan = _plan(found)
    assert "lambdafunction" not in plan and plan.count("only_here") == 1
    got = sorted((r.project_id or "", r.rule, r.severity, r.subject_id, r.detail) for r in found.collect())
    assert got == [("", "all", "note", "x2", None), ("", "has_x", "error", "x2", "x2"), ("p", "all", "note", "x1", None),
                   ("p", "all", "note", "y", None), ("p", "has_x", "error", "x1", "x1")]


def test_exploded_texts_are_searched_once(spark):
    configure(spark)
    rows = spark.createDataFrame([("a 12 b 1,300",), ("none",), (None,)], "text string")
    found = rows.select(F.explode(prose.numbers(F.col("text"))).alias("n"))
    optimised = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("regexp_extract_all") == 1
    assert sorted(r.n for r in found.collect()) == ["12", "1300"]


def test_session_keeps_rules_excluded_before(spark):
    key, mine = "spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.CombineConcats"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, mine)
        configure(configure(spark))
        named = spark.conf.get(key).split(",")
        assert named[0] == mine and len(named) == 2 and named[1].endswith(".InferFiltersFromGenerate")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_short_and_long_runs_yield_the_same_pieces(spark):
    configure(spark)
    long = "".join(str(i % 7) for i in range(drf.PART + 300))
    texts = ["12345", "123", "1,234.5", "٣٤٥٦", "9" * 64, "12345678" * 8 + "9", long]
    runs = spark.createDataFrame([("p", t) for t in texts] + [("q", "777")], "project_id string, run string")
    sizes = spark.createDataFrame([("p", 3), ("p", 5), ("p", 70)], "project_id string, size int")
    got = {(r.project_id, r.token) for r in drf._pieces(runs, sizes).collect()}
    assert got == {("p", t[i:i + n]) for t in texts for n in (3, 5, 70) for i in range(len(t) - n + 1)}


def test_figures_are_ranked_once(spark):
    configure(spark)
    rows = [("p", "a.md", f"{n:03d}") for n in range(11, 0, -1)] + [("p", "b.md", "777"), ("p", None, "888"), (None, "c.md", "999")]
    loose = spark.createDataFrame(rows, "project_id string, name string, token string")
    preview = drf.loose_preview(loose)
    assert _plan(preview).count("Window [") == 1 and "Join" not in _plan(preview)
    got = {(r.project_id, r.name): (r.tokens, r.preview) for r in preview.collect()}
    assert got == {("p", "a.md"): (11, "001, 002, 003, 004, 005, 006, 007, 008 ..."), ("p", "b.md"): (1, "777")}


def test_patterns_with_a_look_ahead_match_as_before():
    """Python's re knows no \\p classes, so they are spelled out; all else is the pattern itself."""
    spelled = lambda p: (p.replace(r"[\p{L}\p{N}_]", r"\w").replace(r"\p{Nd}", r"\d"))
    for pattern, words in ((fixed.DRAFT_BASELINE, ["baseline", "baselines", "base rate", "null model"]),
                           (fixed.DRAFT_EXIT, ["attrition", "survivors", "disappears", "departed", "departures",
                                               "delisted", "churn", "dropped off", "drop-off"]),
                           (fixed.DRAFT_CENSORING, ["censored", "survivorship", "selection bias"])):
        for word in words:
            assert re.search(spelled(pattern), f"the {word} here") and not re.search(spelled(pattern), f"x{word}")


def test_small_tables_are_written_by_many_tasks(spark):
    configure(spark)
    rows = _dealt(spark, spark.range(200).select(F.floor(F.col("id") / 25).alias("n")), "n")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_verdict_over_its_own_projects_reads_findings_once(spark):
    configure(spark)
    rows = [("p", "error"), ("p", "note"), ("q", "note"), ("q", None), (None, "error")]
    found = spark.createDataFrame(rows, "project_id string, severity string")
    own, other = verdict(found, found), verdict(found.select("*"), found)
    assert _plan(own).count("Scan ExistingRDD") == 1 and "Join" not in _plan(own)
    got = {r.project_id: (r.errors, r.notes, r.passed) for r in own.collect()}
    assert got == {"p": (1, 1, False), "q": (0, 1, True), None: (0, 0, True)}
    assert own.dtypes == other.dtypes and sorted(map(str, own.collect())) == sorted(map(str, other.collect()))


def test_cells_are_read_in_compiled_code(spark):
    configure(spark)
    claims = spark.createDataFrame([("p", 1, " yes ", "x"), ("p", 2, None, "x"), ("q", 3, "no", "y")],
                                   "project_id string, row_no bigint, material string, stance string")
    vocabulary = spark.createDataFrame([("p", "material", "yes"), ("p", "nowhere", "x"), ("q", "stance", "for")],
                                       "project_id string, column string, value string")
    fields = voc.melted(vocabulary, {"claims.csv": claims})
    assert "lambdafunction" not in _plan(fields)
    got = sorted((r.project_id, r.row_no, r["column"], r.value) for r in fields.collect())
    assert got == [("p", 1, "material", "yes"), ("p", 2, "material", ""), ("q", 3, "stance", "y")]


def test_landed_repeats_are_the_same_and_meet_rows_without_a_shuffle(spark):
    configure(spark)
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 2, "a"), ("p", 5, "b"), (None, 6, "a"), (None, 7, "a")],
                                 "project_id string, row_no bigint, key string")
    keys = ["project_id", "key"]
    landed = repeats(rows, keys, landed=True)
    assert "BroadcastHashJoin" in _plan(landed) and "Exchange hashpartitioning" not in _plan(landed)
    assert sorted(map(str, landed.collect())) == sorted(map(str, repeats(rows, keys).collect()))
    assert [r.row_no for r in landed.collect()] == [2, 2]


def test_claim_rules_read_tests_instead_of_texts(spark, monkeypatch):
    configure(spark)
    kept = []
    monkeypatch.setattr(clm, "written", lambda df: (kept.append(df.columns), (df, {}))[1])
    claims = spark.createDataFrame([("p", 1, "c1", "!!!", "s1", "n/a", "v0.3", 5), ("p", 2, "?", "fine", "s1", "some", "v0.3", 5)],
                                   "project_id string, row_no bigint, claim_id string, claim_text string, source_id string,"
                                   " uncertainty string, contract string, through_ord int")
    sources = spark.createDataFrame([("p", 1, "s1", "v0.3", 5)],
                                    "project_id string, row_no bigint, source_id string, contract string, through_ord int")
    found = clm.claim_findings(claims, sources).filter("severity = 'error'")
    got = sorted((r.row_no, r.rule) for r in found.collect())
    assert got == [(1, "text_unusable"), (1, "uncertainty_empty"), (2, "id_unusable")]
    assert kept and not any({"claim_text", "uncertainty"} & set(columns) for columns in kept)


def test_a_review_record_is_parsed_once(spark):
    configure(spark)
    projects = spark.createDataFrame([(p, "v0.3", 5) for p in "abcd"], "project_id string, contract string, through_ord int")
    check = fixed.REVIEW_CHECKS[0]
    texts = [("a", '{"checks": {"%s": {"result": " FAIL ", "note": "read", "exception_accepted_by": " "}}}' % check),
             ("b", '{"checks": {"%s": 3}}' % check), ("c", "{bad")]
    rows = rvw.parsed(projects, spark.createDataFrame(texts, "project_id string, value string"))
    optimised = rows._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.lower().count("parse_json") + optimised.count("parseJson") <= 1, optimised
    got = {r.project_id: (r.state, r.exceptional, [c for c in r.checks or [] if c["check"] == check]) for r in rows.collect()}
    first = got["a"][2][0]
    assert got["a"][:2] == ("ok", [check]) and (first.bad_result, first.no_note, first.accepted) == (False, False, False)
    assert got["b"][:2] == ("ok", []) and not got["b"][2][0].is_object
    assert (got["c"][0], got["c"][1], got["d"][0]) == ("malformed", None, "missing")


def test_sections_are_gathered_in_one_pass(spark):
    """Every list of a draft is made from sorted rows, without object hash aggregates and their fallback."""
    configure(spark)
    drafts = spark.createDataFrame([(d, f"Acme Grid has {d} and 77 units. Acme Grid may reach {d + 1}.") for d in range(300)]
                                   + [(5, "Acme Grid has 78 units."), (None, "Acme Grid is 99.")], "draft_id long, text string")
    evidence = spark.createDataFrame([(d, 1, 5, "77 units") for d in range(0, 300, 2)],
                                     "draft_id long, source_ord int, tier int, text string")
    report = audit.audit_report(drafts, evidence)
    assert "ObjectHashAggregate" not in _plan(report)
    assert "SortAggregate" in _plan(grounding.contradictions(grounding.sentence_table(drafts)))
    got = {r.draft_id: r for r in report.collect()}
    assert len(got) == 301 and [t.num for t in got[10].low_trust] == ["77"] and got[11].numbers_missing == ["11", "12", "77"]
    assert [(c.entity, c.nums) for c in got[5].contradictions] == [("Acme Grid", ["5", "6", "77", "78"])]
    assert got[None].numbers_missing == ["99"] and got[7].entities_missing == ["Acme Grid"]


def test_sentences_and_reasons_are_compiled_and_as_before(spark):
    configure(spark)
    rng = random.Random(2)
    bits = ["A", "b.", ".", "!", "?", " ", "  ", "\n", "\t", "\u2003", "\xa0", "x 1,200", "Acme Grid", "may", "in 2031", "[1]", ""]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(400)] + ["", " \n ", ". A", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "draft_id long, text string")
    blanks = fixed.BLANKS
    split = re.compile(f"(?<=[.!?])[{blanks}]+")
    want = {k: [p.strip(blanks) for p in split.split((t or "").replace("\n", " ")) if p.strip(blanks)] for k, t in enumerate(texts)}
    table = grounding.with_reasons(grounding.sentence_table(rows))
    got = {}
    for r in table.collect():
        got.setdefault(r.draft_id, {})[r.sent_no] = r
    assert {k: [v[n].sentence for n in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    hedge = re.compile(r"\b(?:" + "|".join(fixed.HEDGES) + r")\b")
    for r in (r for v in got.values() for r in v.values()):
        dense = len(r.names) > 1 or bool(r.figures)
        assert ("hedged" in r.reasons) == (dense and bool(hedge.search(r.sentence))), r
        assert ("uncited" in r.reasons) == (dense and not hedge.search(r.sentence) and "[1]" not in r.sentence), r
        assert not r.figures or r.reasons[0] == "density"
    plain = spark.createDataFrame([("A b.", ["A"], ["1"])], "text string, names array<string>, figures array<string>")
    assert "lambdafunction" not in _plan(plain.select(
        prose.sentences(F.col("text")), prose.triage_reasons(F.col("text"), F.col("names"), F.col("figures"))))


def test_attribution_patterns_match_as_before(spark):
    configure(spark)
    word, blank = fixed.WORD, fixed.WS
    before = [rf"(?=[A-Z])(?<!{word}){fixed.AGENTS}{blank}+(?:{'|'.join(fixed.ATTRIBUTION_VERBS)})(?!{word})",
              rf"(?<!{word})(?:{'|'.join(fixed.ATTRIBUTION_LEADS)}){blank}+{fixed.AGENTS}{fixed.EDGE}", fixed.ATTRIBUTIONS[2]]
    rng = random.Random(4)
    bits = ["Acme", "Bo.", "O'Neil", "AT&T", "a", "é", "'s", " report", " ", "  ", "said", "told", "saids", "per ", "by\t", "according to ", ".", "-", "X", "Zed9"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(3000)] + ["Bo Zed said", "per Bo.", "Bo's memo"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    was = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in before])
    got = rows.select("text", was.alias("was"), prose.attribution_spans(F.col("text")).alias("now")).collect()
    assert all([s or [] for s in r.now] == r.was for r in got) and all(any(r.was[k] for r in got) for k in range(3))


def test_neighbours_of_sources_are_read_only_where_an_occurrence_leaves_one(spark, monkeypatch):
    configure(spark)
    asked = []
    nearby = attribution.negation_nearby
    monkeypatch.setattr(attribution, "negation_nearby", lambda *a: (asked.append(1), nearby(*a))[1])
    drafts = spark.createDataFrame([(1, "Ada Byron said so.")], "draft_id long, text string")
    for text, after, status in (("x" * 80 + " ada byron " + "y" * 80, "It is denied.", "PRESENT"), ("ada byron", "denied", "NEGATED")):
        evidence = spark.createDataFrame([(1, 1, 2, text), (1, 2, 2, after)], "draft_id long, source_ord int, tier int, text string")
        found = audit.audit_sections(drafts, evidence).attributions.collect()
        assert [r.status for r in found] == [status]
        assert bool(asked) == (status == "NEGATED")
