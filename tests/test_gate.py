"""The gate over many projects at once: every seeded fault is one project folder.

A fault counts as caught only when the named arm reports the named rule.
"""

import json

import pytest
from project_files import (AUTOMATIC, AUTHORITY, INSTRUMENT_BYTES, INSTRUMENTS, ON, RUNNER, Project,
                           catalogue, sha)

from auditloom.operators.approval import ApprovalRules
from auditloom.operators.findings import verdict
from auditloom.plans.gate import Release, evaluate

DELEGATE = "model=Gamma 5; harness=desk; run=40"
CASES = {}


def clean(name, make):
    CASES[name] = (None, None, make)


def fault(arm, rule, name, change, contract="v0.3"):
    def make():
        p = Project(contract)
        change(p)
        return p
    assert name not in CASES
    CASES[name] = (arm, rule, make)


def field(arm, rule, table, key, name, contract="v0.3", **fields):
    fault(arm, rule, name, lambda p: p.set(table, key, **fields), contract)


def record(arm, rule, name, file, **fields):
    fault(arm, rule, name, lambda p: p.records[file].update(fields))


def at(project, **attributes):
    for key, value in attributes.items():
        setattr(project, key, value)
    return project


# ---- clean projects
clean("clean_v03", Project)
clean("clean_v02", lambda: Project("v0.2"))
clean("clean_v01", lambda: at(Project("v0.1"), requested="v0.1"))
clean("clean_multiline", lambda: Project().set(
    "claims.csv", "C2", notes='two\nlines, "quoted"', claim_text="Mean is 247 MW,\nrounded."))


def _held_under_hidden_names():
    """Names Spark's own listing leaves out, and a file longer than the block it is read by."""
    p = Project()
    p.files |= {"_x/a.pdf": b"a", ".b/c": b"c", "long.bin": b"0123456789" * 600_000}
    for key, path in zip(("filing", "release", "audit"), ("_x/a.pdf", ".b/c", "long.bin"), strict=True):
        p.set("sources.csv", key, local_path=path, sha256=sha(p.files[path]))
    return p


clean("clean_hidden_and_long_files", _held_under_hidden_names)
fault("SOURCES", "hash_mismatch", "hidden_file_changed", lambda p: (p.files.update({".b/c": b"c"}), p.set(
    "sources.csv", "release", local_path=".b/c", sha256=sha(b"another"))))


def _legacy_columns():
    p = Project("v0.2")
    p.headers["decisions.csv"].remove("decided_by")
    return p


clean("clean_legacy_decisions", _legacy_columns)


def _early():
    p = at(Project(), through="scope")
    p.tables["sources.csv"], p.tables["claims.csv"] = [], []
    p.records.pop("scope_review.json"), p.records.pop("scope_approval.json")
    return p


clean("clean_partway", _early)
clean("clean_delegated", lambda: Project().approve(approved_by=DELEGATE).policy())
clean("clean_automatic", lambda: Project().approve(approved_by=AUTOMATIC).policy())


def _excepted():
    p = Project().review()
    p.records["scope_review.json"]["checks"]["s4_tests_sufficiency"]["result"] = "Unresolved"
    return p.approve(accepted_checks=["s4_tests_sufficiency"])


clean("clean_excepted", _excepted)


def _domain_column():
    p = Project()
    p.headers["claims.csv"].append("mw")
    for r in p.tables["claims.csv"]:
        r["mw"] = "1"
    return p


clean("clean_domain_column", _domain_column)

# ---- decisions
D, A = "decisions.csv", "DECISIONS"
for contract in ("v0.1", "v0.2", "v0.3"):
    field(A, "no_alternative", D, "G2", f"no_alternative_{contract}", contract, alternatives="")
fault(A, "not_logged", "missing_s6", lambda p: p.drop(D, "S6"), "v0.2")
fault(A, "logged_twice", "decision_twice", lambda p: p.add(D, "G1", decision_id=" g1 "))
field(A, "chosen_empty", D, "D1", "chosen_punctuation", chosen="!!!")
field(A, "chosen_empty", D, "D1", "chosen_placeholder", "v0.2", chosen=" TBD ")
field(A, "rationale_empty", D, "D1", "rationale_punctuation", rationale="***")
field(A, "no_alternative", D, "D1", "alternatives_placeholders", "v0.2", alternatives="tbd|n/a")
field(A, "alternative_unusable", D, "D1", "alternative_punctuation", alternatives="real|!!!")
field(A, "alternative_unusable", D, "D1", "alternatives_all_punctuation", alternatives="!!!|---")
field(A, "date_missing", D, "D1", "no_decided_date", decided_date="")
field(A, "date_not_iso", D, "D1", "bad_decided_date", decided_date="2026-8-4")
for n, who in enumerate(["", "TBD", "role=runner", "!!!", "model=a; harness=b; run=c;",
                         "model=a; model=b; harness=c; run=1", "model=a; harness=b"]):
    field(A, "actor_not_comparable", D, "D1", f"decided_by_{n}", decided_by=who)

# ---- manifest
M, B = "MANIFEST", "instrument_manifest.json"
fault(M, "binding_missing", "no_binding", lambda p: p.records.pop(B), "v0.2")
fault(M, "binding_missing", "no_binding_asked_v03",
      lambda p: (p.records.pop(B), at(p, requested="v0.3")))
fault(M, "binding_not_held", "no_binding_held_v03",
      lambda p: (p.records.pop(B), at(p, requested="v0.3")))
fault(M, "binding_invalid", "malformed_binding", lambda p: p.records.update({B: b"{bad"}), "v0.2")
fault(M, "binding_invalid", "binding_list", lambda p: p.records.update({B: b"[]"}), "v0.2")
fault(M, "binding_invalid", "binding_type",
      lambda p: p.records[B].update(manifest_type="other"), "v0.2")
fault(M, "bound_contract_unknown", "unknown_bound", lambda p: p.records[B].update(contract="v9.9"))
fault(M, "contract_conflict", "conflict", lambda p: at(p, requested="v0.1"), "v0.2")
fault(M, "requested_unknown", "unknown_requested", lambda p: at(p, requested="v7"), "v0.2")
fault(M, "legacy_needs_request", "legacy_unasked", lambda p: None, "v0.1")
fault(M, "instrument_missing", "no_gate_metadata",
      lambda p: p.records[B]["instruments"].pop("gate"))
for rule, key, value in (("instrument_hash_unrecognised", "sha256", "0123456789abcdef" * 4),
                         ("instrument_bytes_differ", "sha256", "0123456789abcdef" * 4),
                         ("instrument_hash_form", "sha256", "ABC"),
                         ("instrument_file", "file", "other"),
                         ("instrument_version", "version", "v9")):
    fault(M, rule, rule, lambda p, k=key, v=value: p.records[B]["instruments"]["gate"].update({k: v}))
fault(M, "binding_schema", "binding_schema", lambda p: p.records[B].pop("schema_version"))
fault(M, "bound_date_invalid", "bound_date", lambda p: p.records[B].update(bound_date="not-a-date"))
fault(M, "instruments_missing", "no_instruments", lambda p: p.records[B].pop("instruments"))
fault(M, "header_differs", "no_corroboration_column",
      lambda p: p.headers["claims.csv"].remove("corroborating_source_id"))
fault(M, "header_differs", "legacy_decisions_v03", lambda p: p.headers[D].remove("decided_by"))
fault(M, "header_differs", "reordered_sources", lambda p: p.headers["sources.csv"].reverse())
fault(M, "header_differs", "legacy_materiality_v02", lambda p: (
    p.headers["claims.csv"].remove("material_to_conclusion"),
    p.headers["claims.csv"].append("load_bearing")), "v0.2")
fault(M, "register_missing", "no_vocabulary_v02", lambda p: p.tables.pop("vocabulary.csv"), "v0.2")
fault("VOCAB", "register_missing", "no_vocabulary_v03", lambda p: p.tables.pop("vocabulary.csv"))
fault(M, "register_empty", "empty_claims", lambda p: p.tables["claims.csv"].clear())

# ---- sources
S, A = "sources.csv", "SOURCES"
field(A, "id_missing", S, "deck", "blank_source_id", source_id=" ")
field(A, "id_unusable", S, "deck", "punctuation_source_id", source_id="!!!")
fault(A, "registered_twice", "source_twice", lambda p: p.add(S, "deck"))
field(A, "tier_invalid", S, "deck", "tier_six", motive_tier="6")
for column, rule in (("source_role", "role_empty"), ("title", "title_empty"),
                     ("publisher", "publisher_empty")):
    field(A, rule, S, "deck", f"{column}_blank", **{column: ""})
    field(A, rule, S, "deck", f"{column}_punctuation", **{column: "***"})
for n, url in enumerate(["!!!", "example.invalid/x", "ftp://h/x", "http://:80", "http://user@",
                         "https://a b.example/", "https://h\\x", "https://h:port/",
                         "https://h:99999/", "https://h/%2"]):
    field(A, "url_unusable", S, "deck", f"url_{n}", url=url)
    field(A, "locator_missing", S, "deck", f"locator_{n}", url=url)
field(A, "locator_missing", S, "deck", "no_locator", url="")
for n, path in enumerate(["sources/none.txt", "/etc/hosts", "../other/sources/filing.txt",
                          "sources/../sources/audit.txt"]):
    field(A, "path_not_held", S, "deck", f"deck_path_{n}", local_path=path)
    field(A, "retrieved_not_held", S, "filing", f"filing_path_{n}", local_path=path)
field(A, "retrieved_without_path", S, "filing", "no_path", local_path="")
field(A, "held_not_hashed", S, "filing", "no_hash", sha256="")
fault(A, "hash_mismatch", "altered_bytes", lambda p: p.files.update({"sources/filing.txt": b"x"}))
fault(A, "retrieved_not_held", "lost_bytes", lambda p: p.files.pop("sources/filing.txt"), "v0.2")
field(A, "unretrieved_without_reason", S, "deck", "no_reason", notes="n/a")
field(A, "unretrieved_without_reason", S, "deck", "punctuation_reason", notes="---")
field(A, "date_missing", S, "audit", "no_accessed_date", accessed_date="")
field(A, "date_not_iso", S, "audit", "bad_accessed_date", accessed_date="in May")
field(A, "date_before_scope", S, "audit", "accessed_early", accessed_date="2026-08-13")
fault(A, "date_before_scope", "late_scope", lambda p: p.set(D, "S6", decided_date="2026-08-20"))
field(A, "origin_unregistered", S, "deck", "unknown_origin", derived_from="nowhere")
field(A, "derives_from_itself", S, "deck", "own_origin", derived_from="deck")
fault(A, "derivation_loop", "loop", lambda p: p.set(S, "audit", derived_from="release")
      .set(S, "release", derived_from="audit"))
field(A, "second_unregistered", S, "deck", "unknown_second", second_source_id="nowhere")
field(A, "second_is_itself", S, "deck", "own_second", second_source_id="deck")
field(A, "second_not_independent", S, "deck", "mirror_second", derived_from="filing")
fault(A, "second_not_independent", "two_hop_ancestor", lambda p: p.set(
    S, "deck", derived_from="release").set(S, "release", derived_from="filing"))
fault(A, "second_not_independent", "two_hop_derivative", lambda p: p.set(
    S, "filing", second_source_id="deck").set(S, "deck", derived_from="release").set(
    S, "release", derived_from="filing"))
fault(A, "second_not_independent", "two_mirrors", lambda p: p.set(
    S, "deck", derived_from="audit", second_source_id="release").set(
    S, "release", derived_from="audit"))
fault(A, "filled_too_early", "early_sources", lambda p: at(p, through="scope"))

# ---- claims
C, A = "claims.csv", "CLAIMS"
for n, value in enumerate(["", "TBD", "!!!"]):
    field(A, "id_unusable", C, "C2", f"claim_id_{n}", claim_id=value)
    field(A, "text_unusable", C, "C2", f"claim_text_{n}", claim_text=value)
    field(A, "uncertainty_empty", C, "C2", f"uncertainty_{n}", uncertainty=value)
fault(A, "id_used_twice", "claim_twice", lambda p: p.add(C, "C2", claim_id="c1"))
field(A, "cites_nothing", C, "C2", "no_source", source_id="")
field(A, "cites_unregistered", C, "C2", "unknown_source", source_id="nowhere")
field(A, "source_not_obtained", C, "C2", "unobtained_source", source_id="deck")
field(A, "corroboration_missing", C, "C3", "no_corroborator", corroborating_source_id="")
field(A, "corroborator_unregistered", C, "C3", "unknown_corroborator",
      corroborating_source_id="nowhere")
field(A, "corroborated_by_itself", C, "C3", "own_corroborator", corroborating_source_id="release")
field(A, "corroborator_not_obtained", C, "C3", "deck_corroborates", corroborating_source_id="deck")
field(A, "corroborator_interested", C, "C3", "interested_pair", corroborating_source_id="deck")
fault(A, "corroborator_unreachable", "unreachable_corroborator", lambda p: p.set(
    S, "audit", url="!!!", local_path="", retrieval_status="cited_not_held"))
fault(A, "corroborator_unreachable", "corroborator_by_traversal", lambda p: p.set(
    S, "audit", url="", local_path="../audit.txt"))
fault(A, "corroborator_not_independent", "shared_origin", lambda p: p.set(
    S, "audit", derived_from="filing").set(S, "release", derived_from="filing"))
field(A, "second_source_missing", S, "release", "alone_v02", "v0.2", second_source_id="")
field(A, "second_source_missing", S, "release", "alone_v01", "v0.1", second_source_id="none")
fault(A, "filled_too_early", "early_claims", lambda p: at(p, through="data"))

# ---- vocabulary and draft
field("VOCAB", "undeclared_value", C, "C2", "undeclared_basis", claim_basis="guessed")
fault("VOCAB", "no_controlled_column", "no_controlled",
      lambda p: [r.update(column=" ") for r in p.tables["vocabulary.csv"]])


def draft(rule, name, old, new):
    fault("DRAFT", rule, name, lambda p: p.files.update(
        {"findings.md": p.files["findings.md"].replace(old, new)}))


draft("no_verification", "no_verification", b"3. Verification", b"Verified")
draft("no_negative_results", "no_negative", b"## Negative results retained", b"## Results")
draft("no_conflict_note", "no_conflict", b"Conflict of interest", b"Interests")
draft("no_falsifier", "no_falsifier", b"## Falsifier\n\nA lower return would prove this wrong.", b"")
fault("DRAFT", "no_draft", "no_draft", lambda p: p.files.update({"findings.md": None}))

# ---- feasibility
F, A = "feasibility.csv", "FEASIBILITY"
fault(A, "no_probes", "no_probes", lambda p: p.tables[F].clear())
fault(A, "register_missing", "probes_missing", lambda p: p.tables.pop(F))
fault(A, "question_not_probed", "no_f4", lambda p: p.drop(F, "F4"))
fault(A, "question_not_probed", "no_f5", lambda p: p.drop(F, "F5"))
fault(A, "recorded_twice", "probe_twice", lambda p: p.add(F, "F1"))
fault(A, "header_differs", "outcome_column", lambda p: p.headers[F].append("count"))
for n, (rule, key, fields) in enumerate([
        ("id_unusable", "F1", dict(probe_id="!!!")), ("id_unusable", "F1", dict(probe_id="")),
        ("source_name_empty", "F1", dict(source_name="***")),
        ("actor_not_comparable", "F1", dict(probed_by="")),
        ("actor_not_comparable", "F1", dict(probed_by="model=a; harness=b")),
        ("question_not_permitted", "F1", dict(question="effect_size")),
        ("result_not_permitted", "F1", dict(result="37 outages")),
        ("result_without_reason", "F1", dict(result="unavailable", notes="")),
        ("result_without_reason", "F1", dict(result="unknown", notes="---")),
        ("date_missing", "F1", dict(access_date="")),
        ("date_not_iso", "F1", dict(access_date="soon")),
        ("date_after_scope", "F1", dict(access_date="2026-08-15")),
        ("retrievable_without_path", "F2", dict(local_path="")),
        ("path_not_held", "F2", dict(local_path="../sample.txt")),
        ("path_not_held", "F2", dict(local_path="/etc/hosts")),
        ("held_not_hashed", "F2", dict(sha256="none")),
        ("hash_mismatch", "F2", dict(sha256="0" * 64)),
        ("period_empty", "F3", dict(stated_period="!!!")),
        ("retention_empty", "F3", dict(retention_policy="")),
        ("derivation_unanswered", "F4", dict(derives_from_subject="maybe")),
        ("coverage_unanswered", "F5", dict(covers_population="")),
        ("locator_missing", "F1", dict(evidence_locator="---", url="https://a b/")),
        ("locator_missing", "F1", dict(evidence_locator="", url="https://h/%G1"))]):
    field(A, rule, F, key, f"probe_{n}", **fields)

# ---- review
R, A = "scope_review.json", "SCOPE_REVIEW"
fault(A, "record_missing", "no_review", lambda p: p.records.pop(R))
fault(A, "record_malformed", "malformed_review", lambda p: p.records.update({R: b"{"}))
fault(A, "record_not_object", "review_list", lambda p: p.records.update({R: b"[1]"}))
record(A, "type_invalid", "review_type", R, record_type="x")
record(A, "schema_invalid", "review_schema", R, schema_version="2.0")
record(A, "contract_invalid", "review_contract", R, contract="v0.2")
for n, who in enumerate(["", "!!!", "reviewer", 7, "model=a; harness=b"]):
    record(A, "reviewer_not_comparable", f"reviewer_{n}", R, reviewer=who)
for n, who in enumerate([RUNNER, RUNNER.upper(), RUNNER.replace("runner", "reviewer"),
                         "model=alpha 9;harness=BENCH;run=17"]):
    record(A, "reviewer_is_maker", f"own_review_{n}", R, reviewer=who)
record(A, "date_missing", "review_no_date", R, review_date="")
record(A, "date_not_iso", "review_bad_date", R, review_date="today")
record(A, "review_before_decision", "review_early", R, review_date="2026-08-13")
record(A, "reviewed_not_object", "reviewed_list", R, reviewed_decisions=[])
fault(A, "reviewed_ids_differ", "reviewed_short",
      lambda p: p.records[R]["reviewed_decisions"].pop("S4"))
fault(A, "reviewed_ids_differ", "reviewed_extra",
      lambda p: p.records[R]["reviewed_decisions"].update(D1="0" * 64))
fault(A, "reviewed_not_logged", "reviewed_unlogged", lambda p: p.drop(D, "S4"))
fault(A, "digest_form", "digest_upper",
      lambda p: p.records[R]["reviewed_decisions"].update(S4="A" * 64))
fault(A, "digest_form", "digest_number", lambda p: p.records[R]["reviewed_decisions"].update(S4=3))
fault(A, "digest_stale", "digest_stale", lambda p: p.set(D, "S4", rationale="another"))
record(A, "checks_not_object", "checks_list", R, checks=[])
fault(A, "checks_differ", "checks_short",
      lambda p: p.records[R]["checks"].pop("s4_tests_sufficiency"))


def check(rule, name, item):
    fault(A, rule, name, lambda p: p.records[R]["checks"].update(s4_tests_sufficiency=item))


check("check_not_object", "check_string", "pass")
check("check_result_invalid", "check_result", {"result": "fine", "note": "read"})
check("check_result_invalid", "check_result_type", {"result": 1, "note": "read"})
check("check_note_empty", "check_no_note", {"result": "pass", "note": ""})
check("check_note_empty", "check_punctuation", {"result": "pass", "note": "..!"})
check("check_note_empty", "check_note_type", {"result": "pass", "note": 12})
check("accepted_in_review", "accepted_in_review",
      {"result": "fail", "note": "read", "exception_accepted_by": "the reviewer"})

# ---- approval
P, A = "scope_approval.json", "SCOPE_APPROVAL"
fault(A, "record_missing", "no_approval", lambda p: p.records.pop(P))
fault(A, "record_malformed", "malformed_approval", lambda p: p.records.update({P: b"nope"}))
fault(A, "record_not_object", "approval_number", lambda p: p.records.update({P: b"3"}))
record(A, "type_invalid", "approval_type", P, record_type="x")
record(A, "schema_invalid", "approval_schema", P, schema_version="")
record(A, "contract_invalid", "approval_contract", P, contract="v0.1")
for n, who in enumerate(["", "the reviewer", "!!!", DELEGATE, AUTOMATIC]):
    record(A, "approver_refused", f"approver_{n}", P, approved_by=who)
record(A, "date_missing", "approval_no_date", P, approval_date="tbd")
record(A, "date_not_iso", "approval_bad_date", P, approval_date="2026-13-01")
record(A, "approval_before_review", "approval_early", P, approval_date="2026-08-01")
record(A, "decision_invalid", "decision_other", P, decision="maybe")
record(A, "not_proceeding", "decision_hold", P, decision="hold")
record(A, "reference_not_string", "reference_number", P, approval_reference=1)
for n, text in enumerate(["", "!!!", "handoffs/a.md", f"decided {ON}", "2026-02-30 a.md",
                          f"{ON} ///", f"{ON} https://h:99999/", f"{ON} https://h/%2"]):
    record(A, "reference_untraceable", f"reference_{n}", P, approval_reference=text)
record(A, "bound_not_object", "bound_list", P, bound_files=[])
fault(A, "bound_set_differs", "bound_short",
      lambda p: p.records[P]["bound_files"].pop("feasibility.csv"))
fault(A, "bound_digest_form", "bound_form",
      lambda p: p.records[P]["bound_files"].update({"feasibility.csv": "x"}))
fault(A, "bound_stale", "question_edited", lambda p: p.set(D, "Q1", chosen="another").review())
fault(A, "bound_stale", "probes_edited", lambda p: p.set(F, "F1", notes="another"))
fault(A, "bound_stale", "review_edited", lambda p: p.records[R].update(review_date="2026-08-14 "))
fault(A, "bound_unresolved", "ambiguous_scope", lambda p: p.add(D, "Q1"))
record(A, "accepted_not_list", "accepted_text", P, accepted_checks="none")
record(A, "accepted_not_list", "accepted_numbers", P, accepted_checks=[1])
record(A, "accepted_unknown", "accepted_unknown", P, accepted_checks=["x"])
record(A, "accepted_set_differs", "accepted_extra", P, accepted_checks=["s4_tests_sufficiency"])
fault(A, "accepted_repeated", "accepted_twice", lambda p: p.records[P].update(
    accepted_checks=["s4_tests_sufficiency"] * 2))
fault(A, "accepted_set_differs", "exception_not_accepted", lambda p: (
    p.records[R]["checks"]["s4_tests_sufficiency"].update(result="fail"), p.approve()))


def delegated(rule, name, approver=DELEGATE, detail=None, **policy):
    fault(A, rule, name, lambda p: p.approve(approved_by=approver).policy(**policy))
    DETAILS[name] = detail


DETAILS = {}
delegated("approver_refused", "policy_type", detail="policy_type_invalid", record_type="x")
delegated("approver_refused", "policy_version", detail="policy_version_invalid", contract="x")
delegated("approver_refused", "policy_owner", detail="policy_owner_invalid", policy_owner="someone")
delegated("approver_refused", "no_permission", detail="not_delegated", delegated_permissions=[])
delegated("approver_refused", "no_auto_permission", AUTOMATIC, "not_delegated",
          delegated_permissions=["clean_scope_approval"])
delegated("approver_refused", "families_empty", detail="families_invalid",
          allowed_model_families=[])
delegated("approver_refused", "families_numbers", detail="families_invalid",
          excluded_model_families=[3])
delegated("approver_refused", "not_comparable", "Gamma", "approver_not_comparable")
delegated("approver_refused", "excluded", "model=Gamma-5 mini; harness=desk; run=1",
          "family_excluded")
delegated("approver_refused", "not_allowed", "model=Delta; harness=desk; run=1",
          "family_not_allowed")
delegated("approver_refused", "reviewer_approves", "model=beta 2; harness=bench; run=18",
          "approver_is_reviewer", allowed_model_families=["Beta"])
delegated("approver_refused", "maker_approves", RUNNER, "approver_made_scope",
          allowed_model_families=["Alpha"])
fault(A, "policy_not_bound", "policy_unbound", lambda p: (p.approve(approved_by=DELEGATE).policy(),
                                                         p.records[P].pop("authority_policy_sha256")))
fault(A, "approver_refused", "delegate_excepts", lambda p: (
    p.records[R]["checks"]["s4_tests_sufficiency"].update(result="fail"),
    p.approve(approved_by=DELEGATE, accepted_checks=["s4_tests_sufficiency"]).policy()))


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("projects"))
    asked = []
    for name, (_, _, make) in CASES.items():
        project = make()
        project.write(root, name)
        asked.append((name, project.requested, project.through))
    projects = spark.createDataFrame(asked, "project_id string, requested string, through string")
    contracts = ("v0.1", "v0.2", "v0.3")
    release = Release(
        spark.createDataFrame([(json.dumps(catalogue()),)], "value string"),
        spark.createDataFrame([(c, k, f) for c in contracts for k, f in INSTRUMENTS.items()],
                              "contract string, key string, file string"),
        spark.createDataFrame([(c, f"frozen/{c}") for c in contracts],
                              "contract string, root string"),
        spark.createDataFrame([(c, f, h) for c in contracts for f, h in INSTRUMENT_BYTES.items()],
                              "contract string, file string, file_sha256 string"))
    known, findings = evaluate(spark, root, projects, release, ApprovalRules([AUTHORITY], AUTOMATIC))
    path = str(tmp_path_factory.mktemp("out") / "findings")
    from auditloom.operators.findings import write_findings
    write_findings(findings, path)
    landed = spark.read.parquet(path)
    by_project: dict = {}
    for r in landed.collect():
        by_project.setdefault(r.project_id, []).append(r)
    passed = {r.project_id: r.passed for r in verdict(known, landed).collect()}
    return by_project, passed


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c[0] is None])
def test_clean_project_passes(outcome, name):
    findings, passed = outcome
    errors = [r for r in findings.get(name, []) if r.severity == "error"]
    assert errors == [] and passed[name]


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c[0] is not None])
def test_fault_is_caught_by_its_arm(outcome, name):
    findings, passed = outcome
    arm, rule, _ = CASES[name]
    hits = [r for r in findings.get(name, [])
            if (r.arm, r.rule, r.severity) == (arm, rule, "error")]
    assert hits, [(r.arm, r.rule) for r in findings.get(name, []) if r.severity == "error"]
    assert not passed[name]
    if DETAILS.get(name):
        assert hits[0].detail == DETAILS[name]


def test_notes(outcome):
    findings, _ = outcome
    notes = {(r.arm, r.rule): r.detail for r in findings["clean_v03"] if r.severity == "note"}
    assert notes[("DECISIONS", "decision_counts")] == "required=27 logged=27"
    assert notes[("SOURCES", "coverage")] == "sources=4 held=3 unretrieved=1 pct=25"
    assert notes[("CLAIMS", "counts")] == "claims=3 material=2"
    assert notes[("FEASIBILITY", "coverage")] == "probes=5 questions=5"
    assert notes[("SCOPE_REVIEW", "reviewed")] == "exceptional=0"
    extra = [r.detail for r in findings["clean_domain_column"] if r.rule == "domain_columns"]
    assert extra == ["mw"]
    early = {r.subject_id for r in findings["clean_partway"] if r.rule == "register_empty_so_far"}
    assert early == {"sources.csv", "claims.csv"}
