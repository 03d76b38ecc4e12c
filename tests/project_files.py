"""Project folders for the gate tests, written with the standard library only.

Nothing here uses the library under test: headers, digests and records are spelled out again, so a
wrong constant on either side shows up as a failing clean project.
"""

from __future__ import annotations

import copy
import csv
import hashlib
import io
import json
import os

RUNNER = "model=Alpha-9; harness=bench; run=17; role=runner"
REVIEWER = "model=Beta-2; harness=bench; run=18; role=reviewer"
AUTHORITY = "Example Review Board"
AUTOMATIC = "controller=opener; rule=clean"
ON = "2026-08-14"

HEADERS = {
    "decisions.csv": "decision_id,stage,question,chosen,alternatives,rationale,decided_date,"
                     "decided_by,revisit_trigger",
    "sources.csv": "source_id,title,publisher,motive_tier,source_role,url,local_path,sha256,"
                   "retrieval_status,accessed_date,second_source_id,derived_from,notes",
    "claims.csv": "claim_id,claim_text,source_id,claim_basis,material_to_conclusion,uncertainty,"
                  "corroborating_source_id,notes",
    "vocabulary.csv": "column,value,definition",
    "feasibility.csv": "probe_id,source_name,question,url,access_date,result,evidence_locator,"
                       "local_path,sha256,stated_period,retention_policy,derives_from_subject,"
                       "covers_population,probed_by,notes",
}
HEADERS = {k: v.split(",") for k, v in HEADERS.items()}
STAGES = {"question": "Q1 Q2 Q3 Q4", "scope": "S1 S2 S3 S4 S5 S6", "data": "D1 D2 D3 D4",
          "digest": "G1 G2 G3 G4 G5", "draft": "R1 R2 R3 R4", "mint": "M1 M2 M3 M4"}
REVIEWED = "Q2 Q3 S1 S2 S3 S4 S6".split()
CHECKS = ["q3_disconfirms_q2", "s1_observable_denominator", "s2_third_party_applicable",
          "s3_vintage_reconstructable", "s4_tests_sufficiency", "s6_matches_population_window"]
BOUND = ["decisions.csv#question_scope", "feasibility.csv", "scope_review.json"]
INSTRUMENTS = {"protocol": "protocol.md", "gate": "gate.bin", "prose_checker": "prose.bin"}
INSTRUMENT_BYTES = {f: hashlib.sha256(f.encode()).hexdigest() for f in INSTRUMENTS.values()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def row_digest(row: dict) -> str:
    return sha("\x1f".join((row.get(c) or "").strip() for c in HEADERS["decisions.csv"]).encode())


def row(name: str, **fields) -> dict:
    return {**{c: "" for c in HEADERS[name]}, **fields}


class Project:
    """Registers as lists of dicts, records as dicts, other files as bytes."""

    def __init__(self, contract="v0.3"):
        self.contract, self.through, self.requested = contract, "mint", None
        self.headers = copy.deepcopy(HEADERS)
        self.files = {"sources/filing.txt": b"Reported capacity 4,200 MW across 17 sites.\n",
                      "sources/sample.txt": b"First bytes of the export.\n",
                      "sources/release.txt": b"The operator states 17 sites.\n",
                      "sources/audit.txt": b"Audit confirms 17 sites.\n"}
        held = {k: sha(v) for k, v in self.files.items()}
        self.tables = {"decisions.csv": [
            row("decisions.csv", decision_id=d, stage=s, question=f"what is {d}",
                chosen=f"the {d} reading", alternatives="wider|narrower",
                rationale="survives a hostile read", decided_date=ON, decided_by=RUNNER,
                revisit_trigger="a restatement") for s, ids in STAGES.items() for d in ids.split()]}
        source = dict(publisher="A body", source_role="authoritative for the return",
                      accessed_date=ON, notes="held, republished in place")
        self.tables["sources.csv"] = [
            row("sources.csv", source_id="filing", title="Return", motive_tier="1",
                url="https://example.invalid/return", local_path="sources/filing.txt",
                sha256=held["sources/filing.txt"], retrieval_status="retrieved", **source),
            row("sources.csv", source_id="deck", title="Deck", motive_tier="5",
                url="https://example.invalid/deck", retrieval_status="registered_not_retrieved",
                second_source_id="filing", **source),
            row("sources.csv", source_id="release", title="Release", motive_tier="5",
                url="https://example.invalid/release", local_path="sources/release.txt",
                sha256=held["sources/release.txt"], retrieval_status="retrieved", **source),
            row("sources.csv", source_id="audit", title="Audit", motive_tier="2",
                url="https://example.invalid/audit", local_path="./sources//audit.txt",
                sha256=held["sources/audit.txt"], retrieval_status="retrieved", **source)]
        self.tables["claims.csv"] = [
            row("claims.csv", claim_id="C1", claim_text="Capacity is 4,200 MW across 17 sites.",
                source_id="filing", claim_basis="reported", material_to_conclusion="yes",
                uncertainty="as filed"),
            row("claims.csv", claim_id="C2", claim_text="Mean is 247 MW.", source_id="filing",
                claim_basis="derived", material_to_conclusion="no", uncertainty="rounded"),
            row("claims.csv", claim_id="C3", claim_text="17 sites were energised.",
                source_id="release", claim_basis="reported", material_to_conclusion="yes",
                uncertainty="as stated", corroborating_source_id="audit")]
        self.tables["vocabulary.csv"] = [
            row("vocabulary.csv", column=c, value=v, definition="d") for c, v in
            [("claim_basis", "reported"), ("claim_basis", "derived"), ("claim_basis", "inferred"),
             ("material_to_conclusion", "yes"), ("material_to_conclusion", "no"),
             ("retrieval_status", "retrieved"), ("retrieval_status", "registered_not_retrieved"),
             ("retrieval_status", "cited_not_held")]]
        probe = dict(source_name="the return", url="https://example.invalid/return",
                     access_date="2026-08-12", result="available", evidence_locator="index page",
                     probed_by=RUNNER, notes="Reachable without a login.")
        self.tables["feasibility.csv"] = [
            row("feasibility.csv", probe_id="F1", question="source_exists", **probe),
            row("feasibility.csv", probe_id="F2", question="bytes_retrievable",
                local_path="sources/sample.txt", sha256=held["sources/sample.txt"], **probe),
            row("feasibility.csv", probe_id="F3", question="period_and_retention",
                stated_period="2019 to 2026", retention_policy="kept", **probe),
            row("feasibility.csv", probe_id="F4", question="derivation_independence",
                derives_from_subject="no", **probe),
            row("feasibility.csv", probe_id="F5", question="population_coverage",
                covers_population="Yes", **probe)]
        self.files["findings.md"] = (
            b"# Worked subject\n\nCapacity is 4,200 MW across 17 sites.\n\n## Falsifier\n\nA lower "
            b"return would prove this wrong.\n\n## 3. Verification\n\nTraced. No baseline was run."
            b"\n\n## Negative results retained\n\nThe deck.\n\n## Conflict of interest\n\nNone.\n")
        self.files["_notes.md"] = b"not a draft"
        self.records = {"instrument_manifest.json": {
            "manifest_type": "project_binding", "schema_version": "1.0", "contract": contract,
            "bound_date": ON, "instruments": {
                key: {"file": name, "version": contract if contract != "v0.1" else "v0",
                      "sha256": INSTRUMENT_BYTES[name]} for key, name in INSTRUMENTS.items()}}}
        if contract != "v0.3":
            self._narrow()
        else:
            self.review()
            self.approve()

    def _narrow(self):
        """The older registers: no probes, no derivation, second source on the source row."""
        self.headers["sources.csv"].remove("derived_from")
        self.headers["claims.csv"].remove("corroborating_source_id")
        del self.tables["feasibility.csv"]
        for r in self.tables["sources.csv"]:
            r["second_source_id"] = r["second_source_id"] or ("audit" if r["motive_tier"] == "5" else "")
        if self.contract == "v0.1":
            self.tables["decisions.csv"] = [r for r in self.tables["decisions.csv"]
                                            if r["decision_id"] != "S6"]
            self.headers["claims.csv"] = ["load_bearing" if c == "material_to_conclusion" else c
                                          for c in self.headers["claims.csv"]]
            for r in self.tables["claims.csv"]:
                r["load_bearing"] = r.pop("material_to_conclusion")
            for r in self.tables["vocabulary.csv"]:
                r["column"] = r["column"].replace("material_to_conclusion", "load_bearing")

    def get(self, table: str, key: str) -> dict:
        return next(r for r in self.tables[table] if next(iter(r.values())) == key)

    def set(self, table: str, key: str, **fields) -> Project:
        self.get(table, key).update(fields)
        return self

    def add(self, table: str, like: str, **fields) -> Project:
        self.tables[table].append({**self.get(table, like), **fields})
        return self

    def drop(self, table: str, key: str) -> Project:
        self.tables[table].remove(self.get(table, key))
        return self

    def csv_bytes(self, name: str) -> bytes:
        out = io.StringIO(newline="")
        writer = csv.DictWriter(out, self.headers[name], extrasaction="ignore")
        writer.writeheader()
        writer.writerows(self.tables[name])
        return out.getvalue().encode()

    def review(self, **changes) -> Project:
        self.records["scope_review.json"] = {
            "record_type": "scope_coherence_review", "schema_version": "1.0", "contract": "v0.3",
            "reviewer": REVIEWER, "review_date": ON,
            "reviewed_decisions": {d: row_digest(self.get("decisions.csv", d)) for d in REVIEWED},
            "checks": {c: {"result": "pass", "note": f"read and confirmed {c}"} for c in CHECKS},
            **changes}
        return self

    def record_bytes(self, name: str) -> bytes:
        return json.dumps(self.records[name], indent=2).encode()

    def scope_digest(self) -> str:
        ids = STAGES["question"].split() + STAGES["scope"].split()
        lines = "".join(f"{d}:{row_digest(self.get('decisions.csv', d))}\n" for d in ids)
        return sha(lines.encode())

    def approve(self, **changes) -> Project:
        self.records["scope_approval.json"] = {
            "record_type": "scope_exception_approval", "schema_version": "1.0", "contract": "v0.3",
            "approved_by": AUTHORITY, "approval_date": ON, "decision": "proceed",
            "accepted_checks": [],
            "approval_reference": f"decision of {ON}, see handoffs/approval.md",
            "bound_files": dict(zip(BOUND, (self.scope_digest(),
                                            sha(self.csv_bytes("feasibility.csv")),
                                            sha(self.record_bytes("scope_review.json"))))),
            **changes}
        return self

    def policy(self, **changes) -> Project:
        self.records["authority_policy.json"] = {
            "record_type": "research_authority_policy", "schema_version": "1.0",
            "contract": "combined-lifecycle-v1", "policy_owner": AUTHORITY,
            "delegated_permissions": ["clean_scope_approval", "automatic_clean_scope_open"],
            "allowed_model_families": ["Gamma"], "excluded_model_families": ["Gamma Mini"],
            **changes}
        self.records["scope_approval.json"]["authority_policy_sha256"] = sha(
            self.record_bytes("authority_policy.json"))
        return self

    def write(self, root: str, name: str) -> None:
        files = dict(self.files)
        files.update({n: self.csv_bytes(n) for n in self.tables})
        for n, record in self.records.items():
            files[n] = record if isinstance(record, bytes) else self.record_bytes(n)
        for rel_path, data in files.items():
            if data is None:
                continue
            path = os.path.join(root, name, rel_path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as fh:
                fh.write(data)


def catalogue() -> dict:
    """A release catalogue that lists the instruments above for every contract."""
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from auditloom import fixed

    contracts = {}
    for name in fixed.CONTRACTS:
        changed = fixed.CONTRACT_EXCEPTIONS.get(name, {})
        stages: dict = {}
        for stage, did, question in fixed.REQUIRED_DECISIONS:
            if changed.get(did, question) is not None:
                stages.setdefault(stage, {})[did] = changed.get(did, question)
        contracts[name] = {
            fixed.CONTRACT_VERSION_FIELDS[name]: fixed.CONTRACT_VERSIONS[name],
            "instrument_root": f"frozen/{name}",
            "required_decisions": sum(map(len, stages.values())), "stages": stages,
            "hashes": {f: [h] for f, h in INSTRUMENT_BYTES.items()}}
    return {"manifest_type": "release_catalogue", "schema_version": "1.2",
            "default_contract": "v0.2", "contracts": contracts}
