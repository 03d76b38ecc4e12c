"""Contracts, register headers, closed word lists, record formats and patterns.

Everything here has to equal the published contract tables, so it is stated as plain text and kept
in one place. Values that name a person, an organisation or an instrument file are *not* here; they
are parameters (see ``operators.approval.ApprovalRules`` and ``sources.catalogue``).
"""

from __future__ import annotations

# ---- fixed values: stages and required decisions ------------------------------------------------

STAGES = ["question", "scope", "data", "digest", "draft", "mint"]

REQUIRED_DECISIONS = [
    ("question", "Q1", "unit of analysis"),
    ("question", "Q2", "the proposition, stated so it can fail"),
    ("question", "Q3", "the falsifier, dated and observable"),
    ("question", "Q4", "describe or score"),
    ("scope", "S1", "population and denominator"),
    ("scope", "S2", "inclusion and exclusion rule"),
    ("scope", "S3", "as-of date and vintage policy"),
    ("scope", "S4", "stop criterion"),
    ("scope", "S5", "research mode per stage"),
    ("scope", "S6", "exit and censoring rule"),
    ("data", "D1", "what counts as primary here"),
    ("data", "D2", "custody policy"),
    ("data", "D3", "non-retrieval policy"),
    ("data", "D4", "second-source rule"),
    ("digest", "G1", "extraction schema"),
    ("digest", "G2", "new-field admission rule"),
    ("digest", "G3", "controlled vocabulary"),
    ("digest", "G4", "derived against reported"),
    ("digest", "G5", "uncertainty form"),
    ("draft", "R1", "the claim ladder"),
    ("draft", "R2", "negative results retained"),
    ("draft", "R3", "register and voice gates"),
    ("draft", "R4", "conflict of interest"),
    ("mint", "M1", "evidence floor met"),
    ("mint", "M2", "ships against stays local"),
    ("mint", "M3", "version and lineage"),
    ("mint", "M4", "commitment gate"),
]
# The first contract has no S6 and words S4 differently.
CONTRACT_EXCEPTIONS = {"v0.1": {"S4": "kill criterion", "S6": None}}

CONTRACTS = ["v0.1", "v0.2", "v0.3"]
DEFAULT_CONTRACT = "v0.2"
LEGACY_CONTRACTS = ["v0.1"]
CONTRACT_VERSIONS = {"v0.1": "v0", "v0.2": "v0.2", "v0.3": "v0.3"}
CONTRACT_VERSION_FIELDS = {
    "v0.1": "guide_version", "v0.2": "protocol_version", "v0.3": "protocol_version"}

# ---- fixed values: register headers -------------------------------------------------------------

DECISION_COLUMNS = ["decision_id", "stage", "question", "chosen", "alternatives", "rationale",
                    "decided_date", "decided_by", "revisit_trigger"]
DECISION_COLUMNS_LEGACY = [c for c in DECISION_COLUMNS if c != "decided_by"]
SOURCE_COLUMNS = ["source_id", "title", "publisher", "motive_tier", "source_role", "url",
                  "local_path", "sha256", "retrieval_status", "accessed_date", "second_source_id",
                  "notes"]
SOURCE_COLUMNS_V03 = SOURCE_COLUMNS[:-1] + ["derived_from", "notes"]
CLAIM_COLUMNS = ["claim_id", "claim_text", "source_id", "claim_basis", "material_to_conclusion",
                 "uncertainty", "notes"]
CLAIM_COLUMNS_V01 = ["load_bearing" if c == "material_to_conclusion" else c for c in CLAIM_COLUMNS]
CLAIM_COLUMNS_V03 = CLAIM_COLUMNS[:-1] + ["corroborating_source_id", "notes"]
VOCABULARY_COLUMNS = ["column", "value", "definition"]
PROBE_COLUMNS = ["probe_id", "source_name", "question", "url", "access_date", "result",
                 "evidence_locator", "local_path", "sha256", "stated_period", "retention_policy",
                 "derives_from_subject", "covers_population", "probed_by", "notes"]
CANDIDATE_COLUMNS = ["candidate_id", "subject", "family", "record", "retrieval_route",
                     "intake_basis", "prior_route_status", "probe_date", "reachable_now",
                     "history_bulk", "archive_fallback", "structured_bytes", "byte_count", "sha256",
                     "admission_decision", "admission_reason", "trial_status", "semantic_review",
                     "publication_status"]

REGISTER_HEADERS = {
    ("decisions.csv", "v0.1"): DECISION_COLUMNS,
    ("decisions.csv", "v0.2"): DECISION_COLUMNS,
    ("decisions.csv", "v0.3"): DECISION_COLUMNS,
    ("sources.csv", "v0.1"): SOURCE_COLUMNS,
    ("sources.csv", "v0.2"): SOURCE_COLUMNS,
    ("sources.csv", "v0.3"): SOURCE_COLUMNS_V03,
    ("claims.csv", "v0.1"): CLAIM_COLUMNS_V01,
    ("claims.csv", "v0.2"): CLAIM_COLUMNS,
    ("claims.csv", "v0.3"): CLAIM_COLUMNS_V03,
    ("vocabulary.csv", "v0.1"): VOCABULARY_COLUMNS,
    ("vocabulary.csv", "v0.2"): VOCABULARY_COLUMNS,
    ("vocabulary.csv", "v0.3"): VOCABULARY_COLUMNS,
    ("feasibility.csv", "v0.3"): PROBE_COLUMNS,
}
REGISTER_NEEDED_AT = {"decisions.csv": "question", "sources.csv": "data", "claims.csv": "digest",
                      "vocabulary.csv": "digest", "feasibility.csv": None}
REGISTER_ARM = {"decisions.csv": "DECISIONS", "sources.csv": "SOURCES", "claims.csv": "CLAIMS",
                "vocabulary.csv": "VOCAB", "feasibility.csv": "FEASIBILITY"}

# ---- fixed values: closed sets ------------------------------------------------------------------

TIERS = ["1", "2", "3", "4", "5"]
INTERESTED_TIERS = ["4", "5"]
RETRIEVED = "retrieved"
NOT_RETRIEVED = "registered_not_retrieved"
SCOPE_IDS = ["S1", "S2", "S3", "S4", "S5", "S6"]
QUESTION_SCOPE_IDS = ["Q1", "Q2", "Q3", "Q4"] + SCOPE_IDS
PROBE_QUESTIONS = ["source_exists", "bytes_retrievable", "period_and_retention",
                   "derivation_independence", "population_coverage"]
PROBE_RESULTS = ["available", "unavailable", "restricted", "unknown"]
TERNARY = ["yes", "no", "unknown"]
ACTOR_FIELDS = ["model", "harness", "run"]
ACTOR_OPTIONAL_FIELDS = ["role"]

# ---- fixed values: review, approval, policy, binding and catalogue records ----------------------

REVIEW_FILE = "scope_review.json"
REVIEW_RECORD_TYPE = "scope_coherence_review"
REVIEW_SCHEMA_VERSION = "1.0"
REVIEW_DECISIONS = ["Q2", "Q3", "S1", "S2", "S3", "S4", "S6"]
REVIEW_CHECKS = ["q3_disconfirms_q2", "s1_observable_denominator", "s2_third_party_applicable",
                 "s3_vintage_reconstructable", "s4_tests_sufficiency",
                 "s6_matches_population_window"]
REVIEW_RESULTS = ["pass", "fail", "unresolved"]

APPROVAL_FILE = "scope_approval.json"
APPROVAL_RECORD_TYPE = "scope_exception_approval"
APPROVAL_SCHEMA_VERSION = "1.0"
APPROVAL_DECISIONS = ["proceed", "hold", "revise"]
APPROVAL_OPENS = "proceed"
APPROVAL_SCOPE_BINDING = "decisions.csv#question_scope"
APPROVAL_BOUND = [APPROVAL_SCOPE_BINDING, "feasibility.csv", REVIEW_FILE]

POLICY_FILE = "authority_policy.json"
POLICY_RECORD_TYPE = "research_authority_policy"
POLICY_SCHEMA_VERSION = "1.0"
POLICY_CONTRACT = "combined-lifecycle-v1"
DELEGATED_PERMISSION = "clean_scope_approval"
AUTOMATIC_PERMISSION = "automatic_clean_scope_open"

BINDING_FILE = "instrument_manifest.json"
BINDING_TYPE = "project_binding"
BINDING_SCHEMA_VERSION = "1.0"
CATALOGUE_TYPE = "release_catalogue"
CATALOGUE_SCHEMA_VERSION = "1.2"

# ---- fixed values: word lists of the grounding audit --------------------------------------------

HEDGES = ["likely", "suggests", "suggest", "potentially", "possibly", "may", "might", "could",
          "appears", "seems", "reportedly", "roughly", "approximately", "around", "estimated",
          "probably", "presumably", "arguably"]
ATTRIBUTION_VERBS = ["said", "told", "announced", "reported", "claimed", "stated", "warned",
                     "wrote", "noted", "covered", "alleged", "confirmed", "accused", "described",
                     "found"]
ATTRIBUTION_LEADS = ["according to", "per", "by"]
ATTRIBUTION_WORKS = ["report", "memo", "study", "claim", "account", "video", "post", "survey",
                     "paper"]
ATTRIBUTION_STOP_SUBJECTS = ["the", "this", "that", "it", "according", "a", "an"]
NEGATION_CUES = ["no evidence", "not ", "n't ", "denied", "never ", "unrelated", "mistak",
                 "wrongly", "incorrectly", "misattribut", "no connection", "rather than",
                 "instead of", "wasn't", "isn't", "no link"]
NEGATION_REACH = 70
LOW_TRUST_TIER = 4
DEFAULT_TIER = 3
DELIMITED_SOURCES = {".csv": ",", ".tsv": "\t"}
DOCUMENT_EXTENSIONS = ["md", "json", "csv", "txt", "pdf", "py"]
PREVIEW_TOKENS = 8
PREVIEW_SENTENCE_CHARS = 140

# ---- fixed values: patterns ---------------------------------------------------------------------
# The audited text rules are defined on Unicode letters, digits and blanks. Java's \w, \d, \s and \b
# are narrower, so the classes are spelled out once and the patterns are composed from them.

BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
WS = (r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
      r"\x{205F}\x{3000}]")
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
EDGE_BEFORE_WORD = rf"(?<!{WORD})"
EDGE_AFTER_WORD = rf"(?!{WORD})"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

PLACEHOLDER = rf"(?iu)^{WS}*(|todo|tbd|n/?a|none|-+|\.\.\.|xxx+|\?+){WS}*$"
HAS_CONTENT = r"[\p{L}\p{N}]"
SHA256_HEX = r"^[0-9a-f]{64}\z"

URL_CHARS = r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+$"
BROKEN_PERCENT = r"%(?![0-9A-Fa-f]{2})"
URL_AUTHORITY = r"(?i)^https?://([^/?#]*)"
ROUTE_TAIL = ".,;:)]}"
ISO_DATE_IN_TEXT = (rf"{EDGE_BEFORE_WORD}{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}{EDGE_AFTER_WORD}")

NUMBER = (rf"(?={DIGIT})(?:(?:0|[1-9]{DIGIT}{{0,2}})(?:,{DIGIT}{{3}})+(?:\.{DIGIT}+)?(?![{DIGIT},])"
          rf"|{DIGIT}+(?:\.{DIGIT}+)?)")
HEX_DIGEST = (rf"{EDGE_BEFORE_WORD}[0-9a-fA-F]{{40}}(?:[0-9a-fA-F]{{24}})?{EDGE_AFTER_WORD}")
BARE_NUMBER = (r"(?<![\p{L}\p{N}_./-])" + rf"{DIGIT}[{DIGIT},]*(?:\.{DIGIT}+)?"
               + r"(?![\p{L}\p{N}_./-])")
PROSE_NUMBER = rf"(?={DIGIT}){EDGE_BEFORE_WORD}{DIGIT}[{DIGIT},]*\.?{DIGIT}*{EDGE}"
PROSE_NOISE = rf"`[^`]*`|https?://{NOT_WS}+"

SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"
NAME = r"[A-Z][a-zA-Z.&/-]+"
# A look-ahead for the first character stands in front of the slower look-behind; it changes no match.
ENTITY = rf"(?=[A-Z]){EDGE_BEFORE_WORD}({NAME}(?:{WS}+{NAME}){{0,3}}){EDGE}"
CITED_URL = r"https?://"
CITED_BRACKET = r"\[[^\]]+\]"
CITED_PARENTHESIS = (rf"\((?:[^)]*{EDGE_BEFORE_WORD}(?:19|20){DIGIT}{{2}}{EDGE_AFTER_WORD}"
                     r"|[^)]*[A-Z][a-z]+)[^)]*\)")
HEDGE = rf"(?iu)(?=[{''.join(sorted({h[0] for h in HEDGES}))}]){EDGE_BEFORE_WORD}(?:{'|'.join(HEDGES)}){EDGE_AFTER_WORD}"
DATE_IN_SENTENCE = (rf"(?={DIGIT})(?:{EDGE_BEFORE_WORD}(19|20){DIGIT}{{2}}{EDGE_AFTER_WORD}"
                    rf"|{EDGE_BEFORE_WORD}{DIGIT}{{1,2}}{WS}+{WORD}+{WS}+{DIGIT}{{4}}"
                    rf"{EDGE_AFTER_WORD})")
AGENT = r"[A-Z][\p{L}\p{N}_.&'-]+"
AGENTS = rf"({AGENT}(?:{WS}+{AGENT}){{0,3}})"
# In front of a verb only a blank can follow a name, so a name gives back no character there (possessive ++).
WHOLE_AGENTS = rf"({AGENT}+(?:{WS}++{AGENT}+){{0,3}})"
ATTRIBUTIONS = [
    rf"(?=[A-Z]){EDGE_BEFORE_WORD}{WHOLE_AGENTS}{WS}++(?:{'|'.join(ATTRIBUTION_VERBS)}){EDGE_AFTER_WORD}",
    rf"(?=[{''.join(sorted({lead[0] for lead in ATTRIBUTION_LEADS}))}]){EDGE_BEFORE_WORD}(?:{'|'.join(ATTRIBUTION_LEADS)}){WS}+{AGENTS}{EDGE}",
    rf"(?=[A-Z]){EDGE_BEFORE_WORD}{AGENTS}'s{WS}+(?:{'|'.join(ATTRIBUTION_WORKS)}){EDGE_AFTER_WORD}",
]
ATTRIBUTION_HOLDS = ["", "", "'s"]  # what every match of a pattern holds; texts without it are not searched
NEGATION = f"(?iu)(?=[{''.join(sorted({c[0] for c in NEGATION_CUES}))}])(" + "|".join(NEGATION_CUES) + ")"

# Draft sections. (?d) keeps line ends at \n only.
DRAFT_FALSIFIER = r"(?d)(?=[fwk])(?:falsif|would prove .{0,20}wrong|kill(s|ed)? the claim)"
DRAFT_VERIFICATION = [
    rf"(?dimu)^#{{1,6}}{WS}*(?:{DIGIT}+(?:\.{DIGIT}+)*[.)]?{WS}+)?verification{EDGE_AFTER_WORD}",
    rf"(?dimu)^{WS}*\*?\*?verification:",
]
DRAFT_COI = ["conflict of interest", rf"{EDGE_BEFORE_WORD}coi{EDGE_AFTER_WORD}"]
_b, _e = EDGE_BEFORE_WORD, EDGE_AFTER_WORD
DRAFT_NEGATIVE = [
    rf"(?dimu)^#{{1,6}}[^\n]*(?=[nlrc])(?:{_b}negative{_e}[^\n]*{_b}results?{_e}|{_b}null results?{_e}"
    rf"|{_b}limitations?{_e}|{_b}retained limits?{_e}|{_b}caveats?{_e})",
    rf"(?dimu)^{WS}*\*?\*?(?:negative results?|limitations?){_e}{WS}*:",
]
DRAFT_BASELINE = rf"(?=[bn]){_b}(?:baselines?{_e}|base rates?{_e}|null model{_e})"
DRAFT_EXIT = (rf"(?=[acds]){_b}(?:attrition{_e}|surviv|disappear|depart(?:ed|ure|ures){_e}"
              rf"|delist|churn{_e}|drop(?:ped)?[ -]off{_e})")
DRAFT_CENSORING = rf"(?=[cs]){_b}(?:censor|survivorship{_e}|selection bias{_e})"
