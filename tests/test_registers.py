"""Register scans, the diff, the catalogue and the programme rules on small hand-made inputs."""

import copy
import csv
import hashlib
import io
import json
import os
import random

import pytest
from project_files import INSTRUMENT_BYTES, INSTRUMENTS, Project, catalogue
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators import decisions, diff, programme, registers
from auditloom.plans import reports
from auditloom.sources import catalogue as cat
from auditloom.sources import records as rec
from auditloom.sources import registers as scans
from auditloom.sources.texts import scan_drafts, scan_texts


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as fh:
        fh.write(data)


def test_scan_counts_logical_records(spark, tmp_path):
    root = str(tmp_path)
    put(root, "p 1/vocabulary.csv", b'column,value,definition\na,"x\ny",\n\n"b ""q""",z\n')
    put(root, "p2/vocabulary.csv", b"value,column,definition\n1,2,3\n")
    rows = scans.scan_cells(spark, root, "vocabulary.csv")
    got = {(r.project_id, r.row_no): (r.header, r.cells) for r in rows.collect()}
    head = ["column", "value", "definition"]
    assert got == {("p 1", 2): (head, ["a", "x\ny", ""]), ("p 1", 3): (head, ['b "q"', "z"]),
                   ("p2", 2): (["value", "column", "definition"], ["1", "2", "3"])}


def test_any_width_equal_names_and_long_rows(spark, tmp_path):
    root, base = str(tmp_path), list(fixed.REGISTER_HEADERS["claims.csv", "v0.3"])
    wide = [f"x{k}" for k in range(200)] + base
    twice = base + ["note", "note"]
    long_row = ",".join(["v"] * (len(base) + 1))
    for project, header, row in (("wide", wide, ",".join(f"v{k}" for k in range(len(wide)))), ("clean", base, ",".join(["v"] * len(base))),
                                 ("twice", twice, ",".join([*["v"] * len(base), "one", "two"])), ("long", base, long_row),
                                 ("later", base, ",".join(["v"] * len(base)) + "\n" + long_row)):
        put(root, f"{project}/claims.csv", f"{','.join(header)}\n{row}\n".encode())
    projects = spark.createDataFrame([(p, "v0.3", 5) for p in ("wide", "clean", "twice", "long", "later")],
                                     "project_id string, contract string, through_ord int")
    rows, heads = scans.read_register(spark, root, "claims.csv", projects)
    got = {r.project_id: r for r in rows.filter("row_no = 2").collect()}
    assert set(got) == {"wide", "clean", "twice", "later"} and len(got["wide"].extra) == 200
    assert got["wide"].extra["x199"] == "v199" and got["wide"].claim_id == f"v{200 + base.index('claim_id')}"
    assert got["twice"].extra == {"note": "two"} and got["clean"].extra == {}
    assert {(r.project_id, r.rule) for r in heads.collect()} == {
        ("wide", "domain_columns"), ("twice", "domain_columns"), ("long", "header_differs")}


def test_diff_of_folders_counts_empty_registers(spark, tmp_path):
    root, head = str(tmp_path), ",".join(fixed.DECISION_COLUMNS)
    legacy = ",".join(fixed.DECISION_COLUMNS_LEGACY)
    row = {c: f"{c}-x" for c in fixed.DECISION_COLUMNS}

    def line(columns, **changes):
        return ",".join({**row, **changes}[c] for c in columns)

    put(root, "a/decisions.csv", "\n".join([head, line(fixed.DECISION_COLUMNS, decision_id="Q1", chosen="one"),
                                            line(fixed.DECISION_COLUMNS, decision_id="Q2", decided_by=""),
                                            line(fixed.DECISION_COLUMNS, decision_id="Q1", chosen="two")]).encode())
    put(root, "b/decisions.csv", head.encode())
    put(root, "c/decisions.csv", "\n".join([legacy, line(fixed.DECISION_COLUMNS_LEGACY, decision_id="q2 ")]).encode())
    got = [(r.decision_id, r.status, r.run_id, r.decided_by, r.chosen) for r in reports.diff_folders(spark, root).collect()]
    assert got == [("Q1", "DIVERGENCE", "a", "decided_by-x", "two"), ("Q1", "DIVERGENCE", "b", "unspecified", "[empty]"),
                   ("Q1", "DIVERGENCE", "c", "unspecified", "[empty]"), ("Q2", "DIVERGENCE", "a", "", "chosen-x"),
                   ("Q2", "DIVERGENCE", "b", "unspecified", "[empty]"), ("Q2", "DIVERGENCE", "c", "unspecified", "chosen-x")]


def test_drafts_are_top_level_markdown(spark, tmp_path):
    root = str(tmp_path)
    for path in ("p/a.md", "p/_b.md", "p/sub/c.md", "p/d.txt"):
        put(root, path, b"bad \xff byte")
    assert [(r.name, r.text) for r in scan_drafts(spark, root).collect()] == [
        ("a.md", "bad � byte")]
    # Spark's own file listing leaves out names with a leading _ or .
    assert scan_texts(spark, root).count() == 3


def test_of_equal_keys_in_a_record_the_last_counts(spark):
    rows = spark.createDataFrame([('{"a": 1, "a": "x"}',), ('{"a": 1, "a"',)], "value string")
    got = rows.select(rec.state(F.col("value")), rec.string_part(rec.record(F.col("value")), "a")).collect()
    assert [tuple(r) for r in got] == [("ok", "x"), ("malformed", None)]


def run_rows(runs):
    out = []
    for run, rows in runs.items():
        for n, (did, chosen) in enumerate(rows, 2):
            out.append((run, n, did, "scope", f"what is {did}", chosen, "a|b", "why", f"by {run}"))
    return out


def test_diff(spark):
    schema = ("run_id string, row_no long, decision_id string, stage string, question string, "
              "chosen string, alternatives string, rationale string, decided_by string")
    rows = spark.createDataFrame(run_rows({
        "a": [("q1", " yes"), ("S1", "x"), ("s1 ", "y"), ("D1", " "), ("", "z")],
        "b": [("Q1", "yes "), ("S1", "y")], "c": [("Q1", "yes"), ("M1", "go")]}), schema)
    got = {r.decision_id: (r.status, r.present, r.runs, r.question)
           for r in diff.decision_diff(rows).collect()}
    assert got == {"Q1": ("CONSENSUS", 3, 3, "what is q1"), "S1": ("DIVERGENCE", 2, 3, "what is s1 "),
                   "M1": ("DIVERGENCE", 1, 3, "what is M1")}
    report = {r.decision_id: r for r in reports.diff_report(rows).collect()}
    assert report["S1"].markdown.startswith("## S1 (scope: what is s1 )\n**Status:** DIVERGENCE")
    assert "- **c** (`unspecified`):\n  - *Chosen:* [empty]" in report["S1"].markdown


def test_scope_digests_and_blocks(spark):
    project = Project()
    rows = [("p", i, *(r[c] for c in fixed.DECISION_COLUMNS))
            for i, r in enumerate(project.tables["decisions.csv"], 2)]
    schema = "project_id string, row_no long, " + ", ".join(
        f"{c} string" for c in fixed.DECISION_COLUMNS)
    frame = spark.createDataFrame(rows, schema)
    assert decisions.scope_digests(frame).first().scope_digest == project.scope_digest()
    block = json.loads(decisions.review_digest_block(frame).first().block)
    assert block["reviewed_decisions"] == project.records["scope_review.json"]["reviewed_decisions"]
    # the diff keeps the last row of a repeated id, the gate the first
    twice = spark.createDataFrame(rows + [("p", 99, *rows[0][2:5], "late", *rows[0][6:])], schema)
    first = registers.first_rows(twice, ["project_id", "decision_id"]).filter("decision_id = 'Q1'")
    last = registers.last_rows(twice, ["project_id", "decision_id"]).filter("decision_id = 'Q1'")
    assert (first.first().chosen, last.first().chosen) == (rows[0][5], "late")
    assert decisions.scope_digests(twice).first().scope_digest is None


@pytest.mark.parametrize("path, value, rule", [
    ([], None, None), (["manifest_type"], "x", "catalogue_type"),
    (["schema_version"], "1", "catalogue_schema"),
    (["default_contract"], "v0.1", "catalogue_default"),
    (["contracts"], [], "catalogue_contracts_not_object"),
    (["contracts", "v9"], {}, "catalogue_contract_set"),
    (["contracts", "v0.2"], 3, "contract_not_object"),
    (["contracts", "v0.1", "guide_version"], "v1", "contract_version"),
    (["contracts", "v0.2", "instrument_root"], "x", "contract_root"),
    (["contracts", "v0.3", "required_decisions"], 26, "contract_required"),
    (["contracts", "v0.3", "stages", "scope", "S4"], "other", "contract_stages"),
    (["contracts", "v0.3", "hashes"], [], "contract_hashes"),
    (["contracts", "v0.3", "hashes", "gate.bin"], [], "hashes_missing"),
    (["contracts", "v0.3", "hashes", "gate.bin"], ["XY"], "hash_form"),
    (["contracts", "v0.3", "hashes", "gate.bin"], ["0" * 64], "released_bytes_unrecognised")])
def test_catalogue(spark, path, value, rule):
    data = copy.deepcopy(catalogue())
    at = data
    for key in path[:-1]:
        at = at[key]
    if path:
        at[path[-1]] = value
    frame = spark.createDataFrame([(json.dumps(data),)], "value string")
    instruments = spark.createDataFrame(
        [(c, k, f) for c in fixed.CONTRACTS for k, f in INSTRUMENTS.items()],
        "contract string, key string, file string")
    roots = spark.createDataFrame([(c, f"frozen/{c}") for c in fixed.CONTRACTS],
                                  "contract string, root string")
    observed = spark.createDataFrame(
        [(c, f, h) for c in fixed.CONTRACTS for f, h in INSTRUMENT_BYTES.items()],
        "contract string, file string, file_sha256 string")
    found = {r.rule for r in cat.catalogue_findings(frame, instruments, roots, observed).collect()}
    assert found == (set() if rule is None else {rule})


def test_programme_rules(spark):
    rows = spark.createDataFrame([("a", "yes", "", "yes"), ("b", "", "Yes ", "yes"),
                                  ("c", "yes", "yes", "no"), ("d", "", "", "yes")],
                                 "candidate_id string, history_bulk string, "
                                 "archive_fallback string, structured_bytes string")
    assert [r.candidate_id for r in programme.admitted(rows).collect()] == ["a", "b"]
    assert [r.candidate_id for r in programme.eligible(
        rows, ["history_bulk", "archive_fallback"]).collect()] == ["c"]
    days = ["2026-06-30"] * 389 + ["2026-06-29"] * 6 + ["2026-05-01"] * 14
    entries = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d string").select(
        "id", F.col("d").cast("date").alias("last_seen"))
    r = programme.exit_rates(entries, F.lit("2026-06-30").cast("date"),
                             F.lit("2026-06-29").cast("date")).first()
    assert (r.entries, r.exits_counted, r.exits_confirmed) == (409, 20, 14)
    assert (r.pct_counted, r.pct_confirmed) == (4.89, 3.42)
    events = spark.createDataFrame([("r", "intervention"), ("r", "correction"), ("s", "correction")],
                                   "run_id string, kind string")
    got = {r.run_id: tuple(r[1:]) for r in programme.runner_measures(events).collect()}
    assert got == {"r": (1, 1, 0), "s": (0, 1, 0)}


def test_scan_reads_what_a_csv_reader_reads(spark, tmp_path):
    """Random files: quotes in and around cells, every kind of line end alone and mixed, quotes never closed."""
    rng, root, want = random.Random(1), str(tmp_path), {}
    parts = ["a", "b", ",", ",", '"', '""', "\n", "\r", "\r\n", " ", "é", '"a"', 'x,"y\nz",', "\t", '"say ""x""\nmore"']
    for k in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        put(root, f"p{k}/r.csv", text.encode())
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        want[f"p{k}"] = [(n, rows[0], r, len(rows[1]) > len(rows[0])) for n, r in enumerate(rows[1:], 2)]
    got = {p: [] for p in want}
    for r in scans.scan_cells(spark, root, "r.csv").collect():
        got[r.project_id].append((r.row_no, r.header, r.cells, r.surplus))
    assert {p: sorted(rows, key=lambda r: r[0]) for p, rows in got.items()} == want


def test_scan_needs_no_python_no_join_and_no_shuffle(spark, tmp_path):
    put(str(tmp_path), "p/r.csv", b"x,y\n1,a\rb\n2,c\n")
    scan = scans.scan_cells(spark, str(tmp_path), "r.csv")
    assert sorted((r.row_no, r.cells) for r in scan.collect()) == [(2, ["1", "a"]), (3, ["b"]), (4, ["2", "c"])]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


def test_long_cells_and_many_quotes_do_not_recurse(spark, tmp_path):
    cell = '"' + '""x' * 60_000 + '"'
    put(str(tmp_path), "p/r.csv", f"a,b\n{cell},{'y' * 300_000}\n{','.join(['z'] * 5000)}\n".encode())
    rows = {r.row_no: r.cells for r in scans.scan_cells(spark, str(tmp_path), "r.csv").collect()}
    assert rows[2] == ['"x' * 60_000, "y" * 300_000] and rows[3] == ["z"] * 5000


def test_held_files_of_any_name_and_size(spark, tmp_path, monkeypatch):
    from auditloom.sources import custody

    monkeypatch.setattr(custody, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(custody, "PROJECTS", 2)
    monkeypatch.setattr(custody, "LISTED_AT_ONCE", 3)
    files = {("p 1", "_x/a.pdf"): b"a", ("p 1", ".b/c"): b"", ("p 1", "_SUCCESS"): b"s", ("p2", "d/e/f/é +%.bin"): b"0123456789" * 1001,
             ("_p3", ".hidden"): b"h", ("p4", "x.csv"): b"1", ("p4", "y.csv"): b"2", ("p4", "z.txt"): b"3", ("p4", "sub/x.csv"): b"4"}
    for (project, path), data in files.items():
        put(str(tmp_path), f"{project}/{path}", data)
    put(str(tmp_path), "not in a project", b"n")
    want = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}

    def read(**args):
        return {(r.project_id, r.rel_path): r.file_sha256 for r in custody.scan_held(spark, f"file:{tmp_path}", **args).collect()}

    assert read() == want
    assert read(glob="*.csv") == {k: v for k, v in want.items() if k[1].endswith(".csv")}
    named = spark.createDataFrame([("p 1", ".b/c"), ("p 1", ".b/c"), ("p2", "x.csv"), ("_p3", ".hidden")], "project_id string, rel_path string")
    assert set(read(named=named)) == {("p 1", ".b/c"), ("_p3", ".hidden")}
    assert custody.scan_held(spark, str(tmp_path / "nothing")).collect() == []


def test_drafts_of_any_name_but_a_leading_underscore(spark, tmp_path):
    for path in ("p/a.md", "p/.x.md", "p/_no.md", "p/sub/no.md", "_q/b.md", ".r/.c.md", "p/.no.txt"):
        put(str(tmp_path), path, path.encode() + b" \xff")
    got = {(r.project_id, r.name): r.text for r in scan_drafts(spark, str(tmp_path)).collect()}
    assert got == {tuple(p.split("/")): f"{p} \ufffd" for p in ("p/a.md", "p/.x.md", "_q/b.md", ".r/.c.md")}


def test_object_state_reads_no_deeper_than_the_top(spark):
    """Every JSON kind, and a record that nests objects; types are not worked out to the last leaf."""
    rows = {"{}": "ok", '{"a": {"b": [1, {"c": null}]}}': "ok", "null": "not_object", "[{}]": "not_object",
            '"{}"': "not_object", "3": "not_object", "{bad": "malformed", None: "missing"}
    frame = spark.createDataFrame([(k,) for k in rows], "value string")
    state = rec.state(F.col("value"))
    got = {r.value: (r.s, r.e) for r in frame.select("value", state.alias("s"), rec.entries(rec.record(F.col("value"))).isNotNull().alias("e")).collect()}
    assert got == {k: (v, v == "ok") for k, v in rows.items()}
    assert "schema_of_variant" not in frame.select(state)._jdf.queryExecution().analyzed().toString()


def test_contracts_of_a_catalogue_are_parsed_once(spark):
    frame = spark.createDataFrame([('{"contracts": {"v0.1": {"hashes": {}}}}',), ('{"contracts": []}',), ("{bad",), (None,)], "value string")
    parts = cat._contract_parts(frame)
    assert sorted((r.contract, r.p) for r in parts.selectExpr("contract", "part IS NOT NULL AS p").collect()) == [
        ("v0.1", True), ("v0.2", False), ("v0.3", False)]
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1


def test_catalogues_of_a_query_are_dealt_out(spark):
    from registry.queries import QUERIES
    plan = QUERIES["catalogue_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Repartition" in plan.optimizedPlan().toString()
    assert len(plan.analyzed().toString()) < 200_000  # every fault once held its predecessor twice


def test_rows_of_one_project_and_one_value_are_dealt_out(spark):
    """One project, one value: its rows meet their vocabulary in many shares, each row in one, none lost."""
    from auditloom.operators import vocabulary as voc
    rows = spark.range(2000).select(
        F.lit("all").alias("project_id"), F.col("id").alias("row_no"), F.lit("odd").alias("claim_basis"), F.lit("v0.3").alias("contract"),
        F.lit(5).alias("through_ord"), F.array(F.lit("claim_basis"), F.lit("stance")).alias("named"),
        F.create_map(F.lit("stance"), F.lit("for")).alias("extra"))
    vocabulary = spark.createDataFrame([("all", "claim_basis", "reported"), ("all", "stance", "for")], "project_id string, column string, value string")
    cells = voc.melted(vocabulary, {"claims.csv": rows})
    per_share = [r["count"] for r in cells.groupBy("project_id", "column", "value", "share").count().collect()]
    assert sum(per_share) == 4000 and max(per_share) < 50
    found = voc.undeclared_values(vocabulary, {"claims.csv": rows})
    assert found.columns == ["project_id", "column", "value", "register", "row_no"]
    assert sorted(r.row_no for r in found.where("column = 'claim_basis'").collect()) == list(range(2000))
    assert found.where("column = 'stance'").count() == 0
    assert [(r.checked, r.columns) for r in voc.checked_counts(vocabulary, {"claims.csv": rows}).collect()] == [(4000, "claim_basis, stance")]
