"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from auditloom import fixed
from registry.views import with_views

SQL: dict[str, str] = {}

BLANKS = fixed.BLANKS
W = (r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
     r"\x{205F}\x{3000}]")


def strip(c: str) -> str:
    return f"trim(coalesce({c}, ''), '{BLANKS}')"


def blank(c: str) -> str:
    return (f"regexp_matches(coalesce({c}, ''), '(?i)^{W}*(|todo|tbd|n/?a|none|-+|\\.\\.\\.|xxx+"
            f"|\\?+){W}*$')")


def punct(c: str) -> str:
    return f"NOT regexp_matches(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}]')"


def unusable(c: str) -> str:
    return f"({blank(c)} OR {punct(c)})"


def iso(c: str) -> str:
    return (f"CASE WHEN regexp_full_match({strip(c)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
            f"THEN TRY_CAST({strip(c)} AS DATE) END")


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def values(rows) -> str:
    def cell(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def contract(name: str) -> str:
    changed = fixed.CONTRACT_EXCEPTIONS.get(name, {})
    rows = [(d, s, changed.get(d, q), fixed.STAGES.index(s))
            for s, d, q in fixed.REQUIRED_DECISIONS if changed.get(d, q) is not None]
    return f"SELECT * FROM ({values(rows)}) AS c(decision_id, stage, question, stage_ord)"


def add(name: str, views: list[str], body: str) -> None:
    SQL[name] = with_views(views, body) if views else body


# ---- decision registers -------------------------------------------------------------------------

DEC = ["fx_decisions"]
add("decision_diff", DEC, f"""
, last AS (SELECT project_id, run_id, decision_id, {strip('chosen')} AS chosen FROM fx_decisions
  QUALIFY row_number() OVER (PARTITION BY project_id, run_id, decision_id ORDER BY row_no DESC) = 1),
runs AS (SELECT DISTINCT project_id, run_id FROM fx_decisions),
ids AS (SELECT DISTINCT project_id, decision_id FROM fx_decisions),
grid AS (SELECT i.project_id, i.decision_id, coalesce(l.chosen, '') AS chosen,
                l.chosen IS NOT NULL AS here
         FROM ids i JOIN runs r USING (project_id)
         LEFT JOIN last l ON l.project_id = i.project_id AND l.run_id = r.run_id
                         AND l.decision_id = i.decision_id)
SELECT project_id, decision_id, count(*) AS runs, count(*) FILTER (here) AS present,
       CASE WHEN count(DISTINCT chosen) = 1 THEN 'CONSENSUS' ELSE 'DIVERGENCE' END AS status
FROM grid GROUP BY project_id, decision_id HAVING bool_or(chosen <> '')""")

add("decision_diff_all_projects", DEC, f"""
, d AS (SELECT *, project_id || '/' || run_id AS run FROM fx_decisions),
last AS (SELECT run, decision_id, {strip('chosen')} AS chosen, decided_by,
  min(row_no) OVER (PARTITION BY run, decision_id) AS row_no FROM d
  QUALIFY row_number() OVER (PARTITION BY run, decision_id ORDER BY row_no DESC) = 1),
runs AS (SELECT DISTINCT run FROM d), ids AS (SELECT DISTINCT decision_id FROM d),
grid AS (SELECT i.decision_id, r.run, coalesce(l.chosen, '') AS chosen, l.decided_by, l.row_no
         FROM ids i CROSS JOIN runs r
         LEFT JOIN last l ON l.run = r.run AND l.decision_id = i.decision_id)
SELECT decision_id, count(*) AS runs, count(row_no) AS present,
       CASE WHEN count(DISTINCT chosen) = 1 THEN 'CONSENSUS' ELSE 'DIVERGENCE' END AS status,
       arg_min(decided_by, run) FILTER (decided_by <> '') AS first_question,
       min(run) FILTER (row_no IS NOT NULL) AS first_run,
       arg_min(row_no, run) FILTER (row_no IS NOT NULL) AS first_row
FROM grid GROUP BY decision_id HAVING bool_or(chosen <> '')""")

add("decision_diff_listed_runs", DEC, f"""
, d AS (SELECT *, project_id || '/' || run_id AS run FROM fx_decisions),
runs AS (SELECT DISTINCT run FROM d UNION ALL SELECT 'p0/none'),
last AS (SELECT run, decision_id, {strip('chosen')} AS chosen, min(row_no) OVER (PARTITION BY run, decision_id) AS row_no
  FROM d SEMI JOIN runs USING (run) QUALIFY row_number() OVER (PARTITION BY run, decision_id ORDER BY d.row_no DESC) = 1),
grid AS (SELECT i.decision_id, r.run, coalesce(l.chosen, '') AS chosen, l.row_no
         FROM (SELECT DISTINCT decision_id FROM last) i CROSS JOIN runs r
         LEFT JOIN last l ON l.run = r.run AND l.decision_id = i.decision_id)
SELECT decision_id, count(*) AS runs, count(row_no) AS present,
       CASE WHEN count(DISTINCT chosen) = 1 THEN 'CONSENSUS' ELSE 'DIVERGENCE' END AS status,
       min(reverse(run)) FILTER (row_no IS NOT NULL) AS first_ord,
       arg_min(row_no, reverse(run)) FILTER (row_no IS NOT NULL) AS first_row
FROM grid GROUP BY decision_id HAVING bool_or(chosen <> '')""")

FIRST = """first AS (SELECT * FROM {src}
  QUALIFY row_number() OVER (PARTITION BY project_id, decision_id ORDER BY row_no) = 1)"""

add("decision_first_wins", DEC, f""", {FIRST.format(src='fx_decisions')}
SELECT project_id, decision_id, row_no, {strip('chosen')} AS chosen FROM first""")
add("decision_repeats", DEC, """
SELECT project_id, decision_id, row_no FROM fx_decisions
QUALIFY row_number() OVER (PARTITION BY project_id, decision_id ORDER BY row_no) > 1""")
add("decision_missing", DEC, f""", c AS ({contract('v0.3')}),
p AS (SELECT DISTINCT project_id FROM fx_decisions)
SELECT p.project_id, c.decision_id, c.stage, c.question FROM p CROSS JOIN c
WHERE NOT EXISTS (SELECT 1 FROM fx_decisions d
                  WHERE d.project_id = p.project_id AND d.decision_id = c.decision_id)""")
add("decision_extra", DEC, f""", c AS ({contract('v0.1')})
SELECT DISTINCT project_id, decision_id FROM fx_decisions
WHERE decision_id NOT IN (SELECT decision_id FROM c WHERE stage_ord <= 1)""")


def decision_findings(name: str) -> str:
    empty = unusable if name == "v0.3" else blank
    toks = ("list_filter(string_split(coalesce(alternatives, ''), '|'), "
            f"lambda t: trim(t, '{BLANKS}') <> '')")
    none_left = "len(toks) = 0"
    if name != "v0.3":
        none_left = f"len(list_filter(toks, lambda t: NOT {blank('t')})) = 0"
    # the six identity parts of the derived decided_by are regular, so one pattern decides
    rules = f"""
SELECT project_id, 'chosen_empty' AS rule, decision_id, row_no, chosen AS detail FROM f WHERE {empty('chosen')}
UNION ALL SELECT project_id, 'rationale_empty', decision_id, row_no, rationale FROM f WHERE {empty('rationale')}
UNION ALL SELECT project_id, 'no_alternative', decision_id, row_no, alternatives FROM f WHERE {none_left}
UNION ALL SELECT project_id, 'date_missing', decision_id, row_no, '' FROM f WHERE {blank('decided_date')}"""
    if name != "v0.1":
        rules += f"""
UNION ALL SELECT project_id, 'date_not_iso', decision_id, row_no, decided_date FROM f
 WHERE NOT {blank('decided_date')} AND ({iso('decided_date')}) IS NULL"""
    if name == "v0.3":
        rules += f"""
UNION ALL SELECT project_id, 'actor_not_comparable', decision_id, row_no, decided_by FROM f
 WHERE NOT regexp_full_match(decided_by, 'model=[^;=]+; harness=[^;=]+; run=[^;=]+')
UNION ALL SELECT project_id, 'alternative_unusable', decision_id, row_no, {strip('t')}
 FROM (SELECT project_id, decision_id, row_no, unnest(toks) AS t FROM f) WHERE {unusable('t')}"""
    return f""", c AS ({contract(name)}), {FIRST.format(src='fx_decisions')},
p AS (SELECT DISTINCT project_id FROM fx_decisions),
f AS (SELECT *, {toks} AS toks FROM first WHERE decision_id IN (SELECT decision_id FROM c)),
r AS ({rules}
UNION ALL SELECT project_id, 'logged_twice', decision_id, row_no, '' FROM fx_decisions
 QUALIFY row_number() OVER (PARTITION BY project_id, decision_id ORDER BY row_no) > 1
UNION ALL SELECT p.project_id, 'not_logged', c.decision_id, 0, c.stage FROM p CROSS JOIN c
 WHERE NOT EXISTS (SELECT 1 FROM first d WHERE d.project_id = p.project_id AND d.decision_id = c.decision_id)
UNION ALL SELECT project_id, 'extra_decision', decision_id, row_no, '' FROM first
 WHERE decision_id NOT IN (SELECT decision_id FROM c)
UNION ALL SELECT project_id, 'decision_counts', '', 0,
 'required=' || (SELECT count(*) FROM c) || ' logged=' || count(*) FROM first GROUP BY project_id)
SELECT project_id, 'DECISIONS' AS arm, rule,
 CASE WHEN rule IN ('extra_decision', 'decision_counts') THEN 'note' ELSE 'error' END AS severity,
 decision_id AS subject_id, row_no, detail FROM r"""


for _name in fixed.CONTRACTS:
    add("decision_findings_" + _name.replace(".", ""), DEC, decision_findings(_name))

DIGEST = ("sha256(concat_ws(chr(31), decision_id, stage, question, "
          + ", ".join(strip(c) for c in ("chosen", "alternatives", "rationale", "decided_date",
                                         "decided_by")) + ", ''))")
DIGESTS = f"""c AS ({contract('v0.3')}), {FIRST.format(src='fx_decisions JOIN c USING (decision_id)')},
digests AS (SELECT project_id, decision_id, decided_by, decided_date, row_no, {DIGEST} AS digest FROM first)"""

add("decision_row_digest", DEC, f""", {DIGESTS}
SELECT project_id, decision_id, digest FROM digests""")
_scope = ", ".join(f"'{d}'" for d in fixed.QUESTION_SCOPE_IDS)
SCOPE_DIGEST = f"""SELECT project_id, CASE WHEN count(*) FILTER (decision_id IN ({_scope})) = 10 THEN
 sha256(string_agg(decision_id || ':' || digest || chr(10), '' ORDER BY decision_id)
        FILTER (decision_id IN ({_scope}))) END AS scope_digest FROM digests GROUP BY project_id"""
add("scope_digest", DEC, f""", {DIGESTS} {SCOPE_DIGEST}""")
add("scope_digest_ambiguous", DEC, f""", {DIGESTS},
n AS (SELECT project_id, max(n) AS n FROM (SELECT project_id, count(*) AS n FROM fx_decisions
      GROUP BY project_id, decision_id) GROUP BY project_id),
s AS ({SCOPE_DIGEST})
SELECT s.project_id, CASE WHEN n.n = 1 THEN s.scope_digest END AS scope_digest
FROM s JOIN n USING (project_id)""")
_review = ", ".join(f"'{d}'" for d in fixed.REVIEW_DECISIONS)
add("review_digest_block", DEC, f""", {DIGESTS}
SELECT project_id, CASE WHEN count(*) = 7 THEN '{{"reviewed_decisions":{{' ||
 string_agg('"' || decision_id || '":"' || digest || '"', ',' ORDER BY decision_id) || '}}}}' END AS block
FROM digests WHERE decision_id IN ({_review}) GROUP BY project_id""")
add("actor_identities", DEC, f""", m AS (SELECT row_no,
 regexp_extract(decided_by, '^model=([^;=]+); harness=([^;=]+); run=([^;=]+)$', ['m', 'h', 'r']) AS x
 FROM fx_decisions)
SELECT row_no, nullif({norm('x.m')}, '') AS model, nullif({norm('x.h')}, '') AS harness,
 nullif({norm('x.r')}, '') AS run, x.m = '' AS not_comparable FROM m""")
LATEST = f"""SELECT project_id, max({iso('decided_date')}) AS latest_scope FROM fx_decisions
WHERE decision_id IN ('S1','S2','S3','S4','S5','S6') GROUP BY project_id"""
add("latest_scope_date", DEC, f" SELECT * FROM ({LATEST}) WHERE latest_scope IS NOT NULL")
add("earliest_scope_date", DEC, f"""
SELECT project_id, min({strip('decided_date')}) AS earliest_scope FROM fx_decisions
WHERE decision_id IN ('S1','S2','S3','S4','S5') AND NOT {blank('decided_date')} GROUP BY project_id""")


# ---- source registers and the derivation graph --------------------------------------------------

def url_ok(c: str) -> str:
    s = strip(c)
    host_port = f"string_split(regexp_extract({s}, '(?i)^https?://([^/?#]*)', 1), '@')[-1]"
    host = f"string_split({host_port}, ':')[1]"
    port = f"substr({host_port}, length({host}) + 2)"
    return (f"(regexp_full_match({s}, '[A-Za-z0-9\\-._~:/?#\\[\\]@!$&''()*+,;=%]+') "
            f"AND len(regexp_extract_all({s}, '%')) = len(regexp_extract_all({s}, '%[0-9A-Fa-f]{{2}}')) "
            f"AND regexp_matches({s}, '(?i)^https?://') AND regexp_matches({host}, '[A-Za-z0-9]') "
            f"AND ({port} = '' OR (regexp_full_match({port}, '[0-9]+') "
            f"AND TRY_CAST({port} AS HUGEINT) BETWEEN 1 AND 65535)))")


def findings(arm: str, rules: list[tuple[str, str, str]], subject: str, source: str,
             notes: tuple = ()) -> str:
    """UNION ALL of (rule, condition, detail) over one source table."""
    return "\nUNION ALL ".join(
        f"SELECT project_id, '{arm}' AS arm, '{rule}' AS rule, "
        f"'{'note' if rule in notes else 'error'}' AS severity, {subject} AS subject_id, row_no, "
        f"CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {when}"
        for rule, when, detail in rules)


SRC = ["fx_sources"]
add("usable_urls", SRC, f""", u AS (SELECT source_id, url FROM fx_sources
 UNION ALL SELECT 'page' || page_id, url FROM pages)
SELECT source_id, url, {url_ok('url')} AS usable FROM u""")


def source_rules(name: str) -> list[tuple[str, str, str]]:
    v03 = name == "v0.3"
    dated = "retrieval_status <> 'retrieved'"  # the derived register holds no paths
    late = f"{dated} AND NOT {blank('accessed_date')}"
    rules = [("tier_invalid", "motive_tier NOT IN ('1','2','3','4','5')", "motive_tier"),
             ("retrieved_without_path", "retrieval_status = 'retrieved'", "''"),
             ("unretrieved_without_reason", "retrieval_status = 'registered_not_retrieved' AND "
              + (unusable("notes") if v03 else blank("notes")), "''"),
             ("date_missing", f"{dated} AND {blank('accessed_date')}", "''"),
             ("date_not_iso", f"{late} AND ({iso('accessed_date')}) IS NULL", "accessed_date"),
             ("date_before_scope", f"{late} AND ({iso('accessed_date')}) < latest_scope",
              "accessed_date")]
    if v03:
        rules += [("role_empty", "true", "''"), ("title_empty", unusable("title"), "''"),
                  ("publisher_empty", unusable("publisher"), "''"),
                  ("url_unusable", f"NOT {url_ok('url')}", "url"),
                  ("locator_missing", f"NOT {url_ok('url')}", "''")]
    return rules


for _name in ("v0.3", "v0.2"):
    add("source_findings_" + _name.replace(".", ""), SRC + DEC, f""",
l AS ({LATEST}), s AS (SELECT x.*, l.latest_scope FROM fx_sources x LEFT JOIN l USING (project_id))
{findings('SOURCES', source_rules(_name), 'source_id', 's')}""")

add("scope_order_violations", SRC + DEC, f""", l AS ({LATEST}),
e AS (SELECT project_id, min({strip('decided_date')}) AS earliest_scope FROM fx_decisions
 WHERE decision_id IN ('S1','S2','S3','S4','S5') AND NOT {blank('decided_date')} GROUP BY project_id)
SELECT 'latest' AS boundary, s.project_id, source_id AS subject_id, row_no
FROM fx_sources s JOIN l USING (project_id)
WHERE retrieval_status <> 'retrieved' AND ({iso('accessed_date')}) < latest_scope
UNION ALL SELECT 'earliest', s.project_id, source_id, row_no FROM fx_sources s JOIN e USING (project_id)
WHERE retrieval_status <> 'retrieved' AND NOT {blank('accessed_date')}
 AND {strip('accessed_date')} < earliest_scope""")

add("source_coverage", SRC, """, c AS (SELECT project_id, count(DISTINCT source_id) AS sources,
 0::BIGINT AS held, count(*) FILTER (retrieval_status = 'registered_not_retrieved') AS unretrieved
 FROM fx_sources GROUP BY project_id)
SELECT *, CAST(round_even(100.0 * unretrieved / sources, 0) AS BIGINT) AS unretrieved_pct FROM c""")

add("source_custody", [], """WITH s AS (SELECT doc_id AS row_no, 'd' || doc_id AS subject_id,
 CASE doc_id % 7 WHEN 0 THEN '../' || source || '/' || doc_id WHEN 1 THEN ''
  WHEN 2 THEN 'texts/lost/' || doc_id ELSE './texts/' || source || '//' || doc_id END AS path,
 sha256(text) AS file, CASE doc_id % 5 WHEN 0 THEN sha256(text || '!') WHEN 1 THEN 'none'
  ELSE sha256(text) END AS recorded, doc_id % 7 > 2 AS held FROM documents),
r AS (SELECT *, 'locator_missing' AS rule, '' AS detail FROM s WHERE NOT held
 UNION ALL SELECT *, 'retrieved_without_path', '' FROM s WHERE path = ''
 UNION ALL SELECT *, 'retrieved_not_held', path FROM s WHERE path <> '' AND NOT held
 UNION ALL SELECT *, 'held_not_hashed', file FROM s WHERE held AND recorded = 'none'
 UNION ALL SELECT *, 'hash_mismatch', file FROM s WHERE held AND recorded <> 'none' AND recorded <> file)
SELECT 'all' AS project_id, 'SOURCES' AS arm, rule, 'error' AS severity, subject_id, row_no, detail FROM r""")

WALK = """par AS (SELECT source_id AS sid, derived_from AS origin FROM fx_sources),
walk(sid, ancestor, hop, seen) AS (
 SELECT sid, origin, 1::BIGINT, [sid, origin] FROM par WHERE origin <> '' AND origin <> sid
 UNION ALL SELECT w.sid, p.origin, hop + 1, list_append(seen, p.origin)
 FROM walk w JOIN par p ON p.sid = w.ancestor WHERE p.origin <> '' AND NOT list_contains(seen, p.origin))"""
add("derivation_closure", SRC, f", {WALK} SELECT sid, hop, ancestor FROM walk")
add("derivation_loops", SRC, f""", {WALK}
SELECT p.sid FROM par p JOIN walk w ON w.sid = p.origin AND w.ancestor = p.sid WHERE p.origin <> p.sid""")
add("derivation_paths", SRC, f""", {WALK}
SELECT sid, ancestor AS target, array_to_string(seen, ' derives from ') AS path FROM walk
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY hop DESC) = 1""")
INDEPENDENCE = """reach AS (SELECT sid, ancestor, hop FROM walk UNION ALL
 SELECT DISTINCT sid, sid, 0::BIGINT FROM (SELECT sid, other FROM pairs UNION ALL SELECT other, sid FROM pairs)),
met AS (SELECT p.sid, p.other, arg_min(a.ancestor, a.hop) AS near FROM pairs p
 JOIN reach a ON a.sid = p.sid JOIN reach b ON b.sid = p.other AND b.ancestor = a.ancestor
 GROUP BY p.sid, p.other),
defects AS (SELECT m.sid, m.other,
 CASE WHEN u.hop IS NOT NULL THEN 'origin' WHEN d.hop IS NOT NULL THEN 'derivative' ELSE 'shared' END AS relation,
 CASE WHEN u.hop IS NOT NULL THEN m.other WHEN d.hop IS NOT NULL THEN m.sid ELSE near END AS shared,
 CASE WHEN u.hop IS NOT NULL THEN array_to_string(u.seen, ' derives from ')
  WHEN d.hop IS NOT NULL THEN array_to_string(d.seen, ' derives from ')
  ELSE array_to_string(e.seen, ' derives from ') || ', and ' || array_to_string(f.seen, ' derives from ') END AS route
 FROM met m LEFT JOIN walk u ON u.sid = m.sid AND u.ancestor = m.other
 LEFT JOIN walk d ON d.sid = m.other AND d.ancestor = m.sid
 LEFT JOIN walk e ON e.sid = m.sid AND e.ancestor = near LEFT JOIN walk f ON f.sid = m.other AND f.ancestor = near)"""
add("independence_defects", SRC, f""", {WALK},
pairs AS (SELECT DISTINCT sid, other FROM (
 SELECT source_id AS sid, second_source_id AS other FROM fx_sources
 UNION ALL SELECT source_id, 's' || (row_no + 2) FROM fx_sources
 UNION ALL SELECT source_id, 's' || (row_no * 3) FROM fx_sources) WHERE sid <> other),
{INDEPENDENCE} SELECT sid, other, relation, shared FROM defects""")
add("source_derivation_findings", SRC, f""", {WALK},
pairs AS (SELECT DISTINCT s.source_id AS sid, t.source_id AS other FROM fx_sources s
 JOIN fx_sources t ON t.source_id = s.second_source_id WHERE t.source_id <> s.source_id),
{INDEPENDENCE},
s AS (SELECT 'all' AS project_id, x.* EXCLUDE (project_id), o.source_id IS NOT NULL AS origin_known,
 t.source_id IS NOT NULL AS second_known, EXISTS (SELECT 1 FROM walk w WHERE w.sid = x.derived_from
  AND w.ancestor = x.source_id) AND x.derived_from <> x.source_id AS looped, d.relation, d.shared, d.route,
 (SELECT arg_max(array_to_string(w.seen, ' derives from '), w.hop) FROM walk w WHERE w.sid = x.source_id)
  || ' derives from ' || x.source_id AS round
 FROM fx_sources x LEFT JOIN fx_sources o ON o.source_id = x.derived_from
 LEFT JOIN fx_sources t ON t.source_id = x.second_source_id
 LEFT JOIN defects d ON d.sid = x.source_id AND d.other = x.second_source_id)
{findings('SOURCES', [
    ('origin_unregistered', "derived_from <> '' AND NOT origin_known", 'derived_from'),
    ('derives_from_itself', "derived_from = source_id", 'derived_from'),
    ('derivation_loop', "looped", 'round'),
    ('second_unregistered', "second_source_id <> '' AND NOT second_known", 'second_source_id'),
    ('second_is_itself', "second_known AND second_source_id = source_id", "''"),
    ('second_not_independent', "relation IS NOT NULL",
     "relation || ' ' || second_source_id || ' ' || shared || ': ' || route"),
], 'source_id', 's')}""")

# ---- claims and vocabulary ----------------------------------------------------------------------

CLM = ["fx_sources", "fx_claims"]
add("claims_unregistered", CLM, """
SELECT claim_id, source_id FROM fx_claims WHERE source_id NOT IN (SELECT source_id FROM fx_sources)""")
add("claims_material_unbacked", CLM, f""", s AS (SELECT source_id AS sid, motive_tier,
 CASE WHEN row_no % 3 = 0 THEN 'n/a' ELSE second_source_id END AS second FROM fx_sources),
c AS (SELECT 'all' AS project_id, c.*, s.* FROM fx_claims c LEFT JOIN s ON s.sid = c.source_id)
{findings('CLAIMS', [
    ('cites_unregistered', 'sid IS NULL', 'source_id'),
    ('uncertainty_empty', f"sid IS NOT NULL AND {blank('uncertainty')}", "''"),
    ('second_source_missing', "material_to_conclusion = 'yes' AND motive_tier IN ('4', '5') AND "
     + blank('second'), 'source_id'),
], 'claim_id', 'c')}""")
_need = "material_to_conclusion = 'yes' AND tier IN ('4', '5')"
_pair = f"{_need} AND NOT {blank('cor')} AND cor_tier IS NOT NULL AND cor <> source_id"
add("claim_findings_v03", CLM, f""", {WALK},
s AS (SELECT source_id AS sid, motive_tier AS tier, retrieval_status AS status, {url_ok('url')} AS reach
 FROM fx_sources),
pairs AS (SELECT DISTINCT c.source_id AS sid, c.corroborating_source_id AS other FROM fx_claims c
 JOIN s a ON a.sid = c.source_id JOIN s b ON b.sid = c.corroborating_source_id
 WHERE c.source_id <> c.corroborating_source_id),
{INDEPENDENCE},
c AS (SELECT 'all' AS project_id, c.*, c.corroborating_source_id AS cor, a.tier, a.status,
 b.tier AS cor_tier, b.status AS cor_status, b.reach AS cor_reach, d.relation, d.shared, d.route
 FROM fx_claims c LEFT JOIN s a ON a.sid = c.source_id
 LEFT JOIN s b ON b.sid = c.corroborating_source_id
 LEFT JOIN defects d ON d.sid = c.source_id AND d.other = c.corroborating_source_id)
{findings('CLAIMS', [
    ('cites_unregistered', 'tier IS NULL', 'source_id'),
    ('uncertainty_empty', f"tier IS NOT NULL AND {unusable('uncertainty')}", "''"),
    ('source_not_obtained', "status = 'registered_not_retrieved'", 'source_id'),
    ('corroboration_missing', f"{_need} AND {blank('cor')}", 'source_id'),
    ('corroborator_unregistered', f"{_need} AND NOT {blank('cor')} AND cor_tier IS NULL", 'cor'),
    ('corroborated_by_itself', f"{_need} AND cor = source_id", 'source_id'),
    ('corroborator_not_obtained', f"{_pair} AND cor_status = 'registered_not_retrieved'", 'cor'),
    ('corroborator_interested', f"{_pair} AND cor_tier IN ('4', '5')", 'cor'),
    ('corroborator_unreachable', f"{_pair} AND NOT cor_reach", 'cor'),
    ('corroborator_not_independent', f"{_pair} AND relation IS NOT NULL",
     "relation || ' ' || cor || ' ' || shared || ': ' || route"),
], 'claim_id', 'c')}
UNION ALL SELECT 'all', 'CLAIMS', 'counts', 'note', '', 0, 'claims=' || count(*) || ' material='
 || count(*) FILTER (tier IS NOT NULL AND material_to_conclusion = 'yes') FROM c""")
_vocab = """v(col, val) AS (VALUES ('claim_basis', 'reported'), ('claim_basis', 'derived'),
 ('claim_basis', 'inferred'), ('retrieval_status', 'retrieved'),
 ('retrieval_status', 'registered_not_retrieved'), ('retrieval_status', 'cited_not_held'),
 ('material_to_conclusion', 'yes'), ('material_to_conclusion', 'no')),
f AS (SELECT 'claims.csv' AS register, row_no, 'claim_basis' AS col, claim_basis AS val FROM fx_claims
 UNION ALL SELECT 'claims.csv', row_no, 'material_to_conclusion', material_to_conclusion FROM fx_claims
 UNION ALL SELECT 'sources.csv', row_no, 'retrieval_status', retrieval_status FROM fx_sources)"""
add("vocab_undeclared", CLM, f""", {_vocab}
SELECT register, row_no, col AS "column", val AS value FROM f
WHERE (col, val) NOT IN (SELECT col, val FROM v)""")
add("vocabulary_findings", CLM, """, v(project_id, col, val) AS (VALUES ('p0', 'stance', 'for'),
 ('p0', 'load_bearing', 'yes'), ('p0', 'claim_basis', 'reported'), ('p1', 'stance', 'against'),
 ('p1', 'retrieval_status', 'retrieved'), ('p1', 'nowhere', 'x')),
cells AS (SELECT 'p' || row_no % 3 AS project_id, 'claims.csv' AS register, row_no, unnest([
  {'col': 'claim_id', 'val': claim_id}, {'col': 'claim_basis', 'val': claim_basis},
  {'col': 'material_to_conclusion', 'val': material_to_conclusion},
  {'col': 'stance', 'val': CASE WHEN row_no % 7 = 0 THEN 'BOGUS' ELSE 'for' END}]) AS f FROM fx_claims
 UNION ALL SELECT 'p' || row_no % 3, 'sources.csv', row_no, unnest([{'col': 'source_id', 'val': source_id},
  {'col': 'retrieval_status', 'val': retrieval_status}]) FROM fx_sources),
met AS (SELECT c.project_id, register, row_no, f.col AS col, f.val AS val FROM cells c
 WHERE EXISTS (SELECT 1 FROM v WHERE v.project_id = c.project_id AND v.col = c.f.col))
SELECT project_id, 'VOCAB' AS arm, 'undeclared_value' AS rule, 'error' AS severity, register AS subject_id, row_no,
 col || ' ' || val AS detail FROM met ANTI JOIN v USING (project_id, col, val)
UNION ALL SELECT 'p2', 'VOCAB', 'no_controlled_column', 'error', '', 0, ''
UNION ALL SELECT v.project_id, 'VOCAB', 'checked', 'note', '', 0, 'checked=' || (SELECT count(*) FROM met m
  WHERE m.project_id = v.project_id) || ' columns=' || string_agg(DISTINCT col, ', ' ORDER BY col) FROM v GROUP BY v.project_id""")
add("vocab_counts", CLM, f""", {_vocab}
SELECT 'all' AS project_id, count(*) AS checked,
 'claim_basis, material_to_conclusion, retrieval_status' AS columns FROM f""")

# ---- feasibility probes -------------------------------------------------------------------------

PRB = ["fx_probes"]
add("probe_findings", PRB + DEC, f""", l AS ({LATEST}),
p AS (SELECT x.*, l.latest_scope FROM fx_probes x LEFT JOIN l USING (project_id))
{findings('FEASIBILITY', [
    ('source_name_empty', 'true', "''"), ('actor_not_comparable', 'true', "''"),
    ('locator_missing', 'true', "''"),
    ('result_not_permitted', "result = '37 outages'", 'result'),
    ('result_without_reason', f"result NOT IN ('37 outages', 'available') AND {unusable('notes')}", 'result'),
    ('date_missing', blank('access_date'), "''"),
    ('date_not_iso', f"NOT {blank('access_date')} AND ({iso('access_date')}) IS NULL", 'access_date'),
    ('date_after_scope', f"({iso('access_date')}) > latest_scope", 'access_date'),
    ('retrievable_without_path', "question = 'bytes_retrievable' AND result = 'available'", "''"),
    ('period_empty', "question = 'period_and_retention'", "''"),
    ('retention_empty', "question = 'period_and_retention'", "''"),
    ('derivation_unanswered', "question = 'derivation_independence'", "''"),
    ('coverage_unanswered', "question = 'population_coverage'", "''"),
], 'probe_id', 'p')}""")
add("probe_coverage", PRB, """, q(question) AS (VALUES ('bytes_retrievable'), ('derivation_independence'),
 ('period_and_retention'), ('population_coverage'), ('source_exists')),
a AS (SELECT DISTINCT project_id, question FROM fx_probes)
SELECT project_id, count(*) AS probes, CAST(count(DISTINCT question) AS INTEGER) AS questions,
 coalesce((SELECT string_agg(q.question, ', ' ORDER BY q.question) FROM q WHERE NOT EXISTS
  (SELECT 1 FROM a WHERE a.project_id = fx_probes.project_id AND a.question = q.question)), '') AS missing,
 bool_and(result = 'unknown') AS all_unknown FROM fx_probes GROUP BY project_id""")
# RE2 has no look-behind, so separators are doubled and consumed instead
_tokens = r"""regexp_extract_all(regexp_replace(notes, '([^\w./,-])', '\1\1', 'g'),
 '(?:^|[^\w./-])(\d[\d,]*(?:\.\d+)?)(?:$|[^\w./-])', 1)"""
_notes = f"""t AS (SELECT project_id, probe_id AS pid, row_no, u.place, u.token FROM fx_probes,
 (SELECT generate_subscripts(x, 1) AS place, unnest(x) AS token FROM (SELECT {_tokens} AS x)) u
 WHERE length(replace(u.token, ',', '')) >= 2)"""
add("probe_numeric_notes", PRB, f""", {_notes} SELECT project_id, pid, token FROM t""")
add("probe_numeric_preview", PRB, f""", {_notes},
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY row_no, place) AS rn FROM t)
SELECT project_id, count(*) AS tokens, string_agg(pid || ':' || token, ', ' ORDER BY rn)
 FILTER (rn <= 8) || CASE WHEN count(*) > 8 THEN ' ...' ELSE '' END AS preview
FROM r GROUP BY project_id""")


# ---- grounding audit ----------------------------------------------------------------------------
# RE2's \b knows ASCII words only, so letters and digits of other scripts are read as underscores:
# a word character no name pattern can contain. Names are ASCII, so what is found is unchanged.

PROSE = ["fx_drafts"]
TEXTS = """texts AS (SELECT 'doc' || doc_id AS draft_id, text FROM documents
 UNION ALL SELECT 'talk-' || conv_id || '-' || turn, text FROM conversations
 UNION ALL SELECT 'item' || item_id, text FROM benchmark
 UNION ALL SELECT 'draft' || draft_id, text FROM fx_drafts)"""


def plain(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F\\p{{Z}}\\p{{P}}\\p{{S}}\\p{{M}}\\p{{C}}]', '_', 'g')"


def nums(c: str) -> str:
    """These texts hold no grouped figures, so after dropping digests the short form is the rule."""
    bare = (f"regexp_replace({plain(c)}, '\\b[0-9a-fA-F]{{40}}(?:[0-9a-fA-F]{{24}})?\\b', ' ', 'g')")
    return f"list_distinct(regexp_extract_all({bare}, '[0-9]+(?:\\.[0-9]+)?'))"


NAME = r"[A-Z][a-zA-Z.&/-]+"
ENT = rf"\b({NAME}(?:{W}+{NAME}){{0,3}})\b"


def sent(source: str) -> str:
    """sents(draft_id, sent_no, sentence, plain, names, figures) of a (draft_id, text) table."""
    pieces = (f"string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?]){W}+', "
              "'\\1' || chr(1), 'g'), chr(1))")
    return f"""cut AS (SELECT draft_id, list_filter(list_transform({pieces},
 lambda s: trim(s, '{BLANKS}')), lambda s: s <> '') AS parts FROM {source}),
flat AS (SELECT draft_id, unnest(range(0, len(parts))) AS n, unnest(parts) AS sentence FROM cut),
marked AS (SELECT draft_id, CAST(n AS INTEGER) AS sent_no, sentence, {plain('sentence')} AS plain,
 {nums('sentence')} AS figures FROM flat),
named AS (SELECT *, regexp_extract_all(plain, '{ENT}', 1) AS found FROM marked),
sents AS (SELECT *, CASE WHEN regexp_matches(plain, '^{ENT}') AND NOT contains(found[1], ' ')
 THEN found[2:] ELSE found END AS names FROM named)"""


_hedge = rf"(?i)\b(?:{'|'.join(fixed.HEDGES)})\b"
_dense = "(len(names) > 1 OR len(figures) > 0)"
TRIAGED = rf"""flagged AS (SELECT *, regexp_matches(plain, '{_hedge}') AS hedged,
 regexp_matches(plain, 'https?://') OR regexp_matches(plain, '\[[^\]]+\]') OR regexp_matches(plain,
 '\((?:[^)]*\b(?:19|20)\d{{2}}\b|[^)]*[A-Z][a-z]+)[^)]*\)') AS cited,
 regexp_matches(plain, '\b(?:19|20)\d{{2}}\b|\b\d{{1,2}}{W}+\w+{W}+\d{{4}}\b') AS dated FROM sents),
triaged AS (SELECT * FROM (SELECT *, concat_ws('+',
 CASE WHEN len(names) > 2 OR len(figures) > 0 OR dated THEN 'density' END,
 CASE WHEN hedged AND {_dense} THEN 'hedged' END,
 CASE WHEN NOT hedged AND NOT cited AND {_dense} THEN 'uncited' END) AS reasons FROM flagged)
 WHERE reasons <> '')"""

add("sentences", PROSE, f", {TEXTS}, {sent('texts')} SELECT draft_id, sent_no, sentence FROM sents")
add("sentence_names", PROSE, f""", {TEXTS}, {sent('texts')}
SELECT draft_id, sent_no, CAST(unnest(range(0, len(names))) AS INTEGER) AS place,
 unnest(names) AS entity FROM sents""")
add("text_numbers", PROSE, f""", {TEXTS}
SELECT draft_id, unnest({nums('text')}) AS num FROM texts""")
add("triage", PROSE, f""", {TEXTS}, {sent('texts')}, {TRIAGED}
SELECT draft_id, sent_no, substr(sentence, 1, 140) AS opening, reasons FROM triaged""")
CONTRA = """pairs AS (SELECT DISTINCT draft_id, entity, unnest(figures) AS num FROM
 (SELECT draft_id, unnest(list_distinct(names)) AS entity, figures FROM sents)),
contra AS (SELECT draft_id, entity, list(num ORDER BY num COLLATE "C") AS nums FROM pairs
 GROUP BY draft_id, entity HAVING count(*) > 1)"""
CONTRA = CONTRA.replace(' COLLATE "C"', "")
add("entity_contradictions", PROSE, f""", {TEXTS}, {sent('texts')}, {CONTRA}
SELECT draft_id, entity, array_to_string(nums, ',') AS nums FROM contra""")
GND = ["fx_drafts", "fx_evidence"]
GROUNDED = f"""want AS (SELECT draft_id, unnest({nums('text')}) AS num FROM fx_drafts),
give AS (SELECT draft_id, num, min(tier) AS best_tier FROM (SELECT draft_id, tier,
 unnest({nums('text')}) AS num FROM fx_evidence) GROUP BY draft_id, num),
grounded AS (SELECT w.draft_id, w.num, g.best_tier FROM want w LEFT JOIN give g
 ON g.draft_id = w.draft_id AND g.num = w.num WHERE length(w.num) >= 2)"""
add("ungrounded_numbers", GND, f", {GROUNDED} SELECT draft_id, num FROM grounded WHERE best_tier IS NULL")
add("tier_only_numbers", GND, f", {GROUNDED} SELECT draft_id, num, best_tier FROM grounded WHERE best_tier >= 4")
add("document_number_grounding", [], f"""WITH want AS (SELECT doc_id AS draft_id, unnest({nums('text')}) AS num
 FROM documents), give AS (SELECT DISTINCT doc_id // 2 AS draft_id, unnest({nums('text')}) AS num FROM documents)
SELECT w.draft_id, w.num, g.num IS NOT NULL AS grounded FROM want w LEFT JOIN give g
 ON g.draft_id = w.draft_id AND g.num = w.num WHERE length(w.num) >= 2""")
MISSING = """names AS (SELECT DISTINCT draft_id, unnest(names) AS entity FROM triaged),
missing AS (SELECT draft_id, entity FROM names n WHERE NOT EXISTS (SELECT 1 FROM {evidence} e
 WHERE e.draft_id = n.draft_id AND contains(lower(e.text), lower(n.entity))))"""
add("missing_entities", GND, f""", {sent('fx_drafts')}, {TRIAGED}, {MISSING.format(evidence='fx_evidence')}
SELECT draft_id, entity FROM missing""")
add("document_missing_entities", [], f"""WITH d AS (SELECT doc_id AS draft_id, text FROM documents),
n AS (SELECT doc_id - 1 AS draft_id, text FROM documents), {sent('d')}, {TRIAGED},
{MISSING.format(evidence='n')} SELECT draft_id, entity FROM missing""")
# The agent class of attributions admits every word character, so the plain form would change the
# text of a subject. These texts attribute to ASCII subjects only; others would show as a mismatch.
_agent = r"[A-Z][\w.&''-]+"
_agents = rf"({_agent}(?:{W}+{_agent}){{0,3}})"
_by = [rf"\b{_agents}{W}+(?:{'|'.join(fixed.ATTRIBUTION_VERBS)})\b",
       rf"\b(?:{'|'.join(fixed.ATTRIBUTION_LEADS)}){W}+{_agents}\b",
       rf"\b{_agents}''s{W}+(?:{'|'.join(fixed.ATTRIBUTION_WORKS)})\b"]
_stop = ", ".join(f"'{s}'" for s in fixed.ATTRIBUTION_STOP_SUBJECTS)
_spans = "\n UNION ALL ".join(
    f"SELECT draft_id, sent_no, sentence, {i} AS pattern, unnest(range(0, len(x))) AS match, unnest(x) AS subject "
    f"FROM (SELECT *, regexp_extract_all(plain, '{p}', 1) AS x FROM sents)" for i, p in enumerate(_by))
ATTRIBUTED = f"""spans AS ({_spans}),
said AS (SELECT draft_id, lower(subject) AS key, subject, sentence FROM spans
 WHERE lower(subject) NOT IN ({_stop})
 QUALIFY row_number() OVER (PARTITION BY draft_id, lower(subject) ORDER BY sent_no, pattern, match) = 1)"""
add("attributions", PROSE + ["fx_said"], f""", {TEXTS}, every AS (SELECT * FROM texts
 UNION ALL SELECT 'said' || draft_id, text FROM fx_said), {sent('every')}, {ATTRIBUTED}
SELECT draft_id, key, subject, sentence FROM said""")
_cues = "(" + "|".join(c.replace("'", "''") for c in fixed.NEGATION_CUES) + ")"
BOUND = f"""joined AS (SELECT draft_id, lower(string_agg(text, chr(10) ORDER BY source_ord)) AS src
 FROM heard GROUP BY draft_id),
cutup AS (SELECT s.draft_id, s.key, s.subject, string_split(src, s.key) AS parts
 FROM said s LEFT JOIN joined j ON j.draft_id = s.draft_id),
pieces AS (SELECT *, CASE WHEN i = 1 THEN '' ELSE key END AS lead FROM (SELECT draft_id, key, subject,
 len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM cutup)),
seen AS (SELECT *, right(string_agg(lead || right(part, 70), '') OVER (PARTITION BY draft_id, key
  ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 70) || left(string_agg(lead || left(part, 70), '')
  OVER (PARTITION BY draft_id, key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), length(key) + 70) AS view
 FROM pieces),
status AS (SELECT s.draft_id, s.subject, CASE WHEN coalesce(max(v.n), 1) = 1 THEN 'ABSENT'
 WHEN bool_or(v.i < v.n AND NOT regexp_matches(v.view, '(?i){_cues}')) THEN 'PRESENT' ELSE 'NEGATED' END AS status
 FROM said s LEFT JOIN seen v ON v.draft_id = s.draft_id AND v.key = s.key GROUP BY s.draft_id, s.key, s.subject)"""
add("attribution_binding", ["fx_said", "fx_heard"], f""", heard AS (SELECT * FROM fx_heard),
{sent('fx_said')}, {ATTRIBUTED}, {BOUND} SELECT draft_id, subject, status FROM status""")
add("attribution_binding_one_draft", ["fx_heard"], f""", heard AS (SELECT 0::BIGINT AS draft_id,
 draft_id * 3 + source_ord AS source_ord, text FROM fx_heard),
one AS (SELECT 0::BIGINT AS draft_id, 'Acme Power Grid said so. It was covered by Promotional Desk, per '
 || 'Filing Office. Nobody Known denied it; Building Board announced more.' AS text),
{sent('one')}, {ATTRIBUTED},
{BOUND}
SELECT draft_id, subject, status FROM status""")
AUDIT = f"""{sent('fx_drafts')}, {TRIAGED}, {GROUNDED}, {MISSING.format(evidence='fx_evidence')},
{CONTRA}, {ATTRIBUTED}"""
add("audit_verdict", GND, f""", {AUDIT}, flags AS (
 SELECT draft_id FROM grounded WHERE best_tier IS NULL OR best_tier >= 4
 UNION ALL SELECT draft_id FROM missing UNION ALL SELECT draft_id FROM contra
 UNION ALL SELECT draft_id FROM said)
SELECT d.draft_id, count(f.draft_id) AS hard_flags, count(f.draft_id) = 0 AS clean
FROM fx_drafts d LEFT JOIN flags f USING (draft_id) GROUP BY d.draft_id""")
add("audit_report", GND, f""", {AUDIT},
a AS (SELECT draft_id, string_agg(num, ',' ORDER BY -length(num), num) FILTER (best_tier IS NULL) AS nm,
 string_agg(num || '@' || best_tier, ',' ORDER BY -length(num), num) FILTER (best_tier >= 4) AS lt,
 count(*) FILTER (best_tier IS NULL OR best_tier >= 4) AS n FROM grounded GROUP BY draft_id),
b AS (SELECT draft_id, string_agg(entity, ',' ORDER BY entity) AS em, count(*) AS n FROM missing GROUP BY draft_id),
c AS (SELECT draft_id, string_agg(entity || ':' || array_to_string(nums, '/'), ',' ORDER BY entity) AS co,
 count(*) AS n FROM contra GROUP BY draft_id),
t AS (SELECT draft_id, count(*) AS n FROM triaged GROUP BY draft_id)
SELECT d.draft_id, coalesce(nm, '') AS numbers_missing, coalesce(em, '') AS entities_missing,
 coalesce(co, '') AS contradictions, coalesce(lt, '') AS low_trust, 0 AS attributions,
 CAST(coalesce(t.n, 0) AS INTEGER) AS triage,
 CAST(coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) AS INTEGER) AS hard_flags,
 coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) = 0 AS clean
FROM fx_drafts d LEFT JOIN a USING (draft_id) LEFT JOIN b USING (draft_id) LEFT JOIN c USING (draft_id)
LEFT JOIN t USING (draft_id)""")


# ---- drafts of projects -------------------------------------------------------------------------

def sections(text: str) -> dict[str, str]:
    p = plain(text)
    low = f"lower({p})"
    head, neg = rf"^{W}*\*?\*?", r"\bnegative\b[^\n]*\bresults?\b"
    return {
        "has_falsifier": f"regexp_matches({low}, 'falsif|would prove .{{0,20}}wrong|kill(s|ed)? the claim')",
        "has_verification": (f"(regexp_matches({p}, '(?im)^#{{1,6}}{W}*(?:\\d+(?:\\.\\d+)*[.)]?{W}+)?verification\\b')"
                             f" OR regexp_matches({p}, '(?im){head}verification:'))"),
        "has_coi": f"(contains({low}, 'conflict of interest') OR regexp_matches({low}, '\\bcoi\\b'))",
        "has_negative_results": (
            f"(regexp_matches({p}, '(?im)^#{{1,6}}[^\\n]*(?:{neg}|\\bnull results?\\b|\\blimitations?\\b"
            f"|\\bretained limits?\\b|\\bcaveats?\\b)') OR regexp_matches({p}, "
            f"'(?im){head}(?:negative results?|limitations?)\\b{W}*:'))"),
        "names_baseline": f"regexp_matches({low}, '\\bbaselines?\\b|\\bbase rates?\\b|\\bnull model\\b')",
        "exit_without_censoring": (
            f"(regexp_matches({low}, '\\battrition\\b|\\bsurviv\\w*|\\bdisappear\\w*|\\bdepart(?:ed|ure|ures)\\b"
            f"|\\bdelist\\w*|\\bchurn\\b|\\bdrop(?:ped)?[ -]off\\b') AND NOT regexp_matches({low}, "
            "'\\bcensor\\w*|\\bsurvivorship\\b|\\bselection bias\\b'))"),
    }


FLAGS = ", ".join(f"{expr} AS {name}" for name, expr in sections("text").items())
add("draft_sections", ["fx_reports"], f""", t AS (SELECT name, text FROM fx_reports
 UNION ALL SELECT 'doc' || doc_id, text FROM documents UNION ALL SELECT 'page' || page_id, html FROM pages)
SELECT name, {FLAGS} FROM t""")
LOOSE = f"""said AS (SELECT project_id, string_agg(claim_text || ' ' || uncertainty, ' ') AS said
 FROM fx_project_claims GROUP BY project_id),
tokens AS (SELECT project_id, name, unnest(list_distinct(list_filter(regexp_extract_all(
 regexp_replace(text, '`[^`]*`|https?://[^{W[1:-1]}]+', ' ', 'g'), '\\b[0-9][0-9,]*\\.?[0-9]*\\b'),
 lambda t: length(t) > 2))) AS token FROM fx_reports),
loose AS (SELECT t.* FROM tokens t JOIN said s USING (project_id) WHERE NOT contains(said, token))"""
DRF = ["fx_reports", "fx_project_claims"]
add("loose_numbers", DRF, f", {LOOSE} SELECT project_id, name, token FROM loose")
_missing = [("no_falsifier", "NOT has_falsifier", "''"), ("no_verification", "NOT has_verification", "''"),
            ("no_conflict_note", "NOT has_coi", "''"),
            ("no_negative_results", "NOT has_negative_results", "''"),
            ("no_baseline", "NOT names_baseline", "''"),
            ("exit_without_censoring", "exit_without_censoring", "''")]
add("draft_findings", DRF, f""", {LOOSE}, f AS (SELECT project_id, name, 0::BIGINT AS row_no, {FLAGS} FROM fx_reports),
o AS (SELECT DISTINCT 'p' || c_custkey % 20 AS project_id FROM customer),
n AS (SELECT project_id, name, count(*) AS n, array_to_string(list(token ORDER BY token)[1:8], ', ')
 || CASE WHEN count(*) > 8 THEN ' ...' ELSE '' END AS shown FROM loose GROUP BY project_id, name)
{findings('DRAFT', _missing, 'name', 'f', notes=('no_baseline', 'exit_without_censoring'))}
UNION ALL SELECT project_id, 'DRAFT', 'no_draft', 'error', '', 0, '' FROM o
 WHERE project_id NOT IN (SELECT project_id FROM fx_reports)
UNION ALL SELECT project_id, 'DRAFT', 'loose_numbers', 'note', name, 0, n || ': ' || shown FROM n""")

# ---- bindings, reviews and approvals ------------------------------------------------------------

BND = ["fx_bindings"]
BOUND_STATE = """b AS (SELECT project_id, requested, 0::BIGINT AS row_no, substr(project_id, 2)::BIGINT AS n,
 value IS NOT NULL AND json_valid(value) AS valid, value FROM fx_bindings),
s AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN NOT valid THEN 'malformed'
 WHEN json_type(value) <> 'OBJECT' THEN 'not_object'
 WHEN value ->> '$.manifest_type' <> 'project_binding' THEN 'wrong_type' ELSE 'ok' END AS state,
 CASE WHEN valid THEN lower(trim(value ->> '$.contract')) ELSE '' END AS bound, lower(trim(requested)) AS asked FROM b),
r AS (SELECT *, coalesce(bound IN ('v0.1', 'v0.2', 'v0.3'), false) AS bound_known,
 coalesce(asked IN ('v0.1', 'v0.2', 'v0.3'), false) AS asked_known FROM s),
c AS (SELECT *, CASE WHEN asked_known THEN asked ELSE 'v0.2' END AS in_force,
 CASE WHEN state = 'ok' AND bound_known THEN bound WHEN asked_known THEN asked ELSE 'v0.2' END AS contract FROM r)"""
add("contract_resolution", BND, f", {BOUND_STATE} SELECT project_id, state, contract FROM c")
add("contract_resolution_findings", BND, f""", {BOUND_STATE}
{findings('MANIFEST', [
    ('requested_unknown', 'requested IS NOT NULL AND NOT asked_known', 'requested'),
    ('binding_missing', "state = 'missing' AND coalesce(asked, '') <> 'v0.1'", "''"),
    ('legacy_without_binding', "state = 'missing' AND asked = 'v0.1'", "''"),
    ('binding_invalid', "state NOT IN ('ok', 'missing')", 'state'),
    ('contract_conflict', "requested IS NOT NULL AND state = 'ok' AND bound <> in_force", 'bound'),
    ('bound_contract_unknown', "state = 'ok' AND NOT bound_known", 'bound'),
    ('legacy_needs_request', "requested IS NULL AND state = 'ok' AND bound = 'v0.1'", 'bound'),
    ('binding_not_held', "state = 'missing' AND contract = 'v0.3'", "''"),
], "''", 'c', notes=('legacy_without_binding',))}""")
_item = "json_extract(value, '$.instruments.' || key)"
add("binding_instruments", BND, f""", {BOUND_STATE},
k(key, file) AS (VALUES ('gate', 'gate.bin'), ('notes', 'notes.md')),
h AS (SELECT c.*, k.*, {_item} AS item FROM c CROSS JOIN k WHERE state = 'ok'),
i AS (SELECT *, coalesce(json_type(item) = 'OBJECT', false) AS listed,
 CASE WHEN json_type(item, '$.file') = 'VARCHAR' THEN item ->> '$.file' END AS f,
 CASE WHEN json_type(item, '$.version') = 'VARCHAR' THEN item ->> '$.version' END AS v,
 CASE WHEN json_type(item, '$.sha256') = 'VARCHAR' THEN item ->> '$.sha256' END AS sha,
 CASE contract WHEN 'v0.1' THEN 'v0' ELSE contract END AS wanted,
 CASE WHEN key = 'gate' AND contract = 'v0.2' THEN repeat('ab', 32)
      WHEN key = 'gate' AND contract = 'v0.3' THEN repeat('cd', 32) END AS seen FROM h),
j AS (SELECT *, listed AND coalesce(regexp_full_match(sha, '[0-9a-f]{{64}}'), false) AS formed FROM i)
{findings('MANIFEST', [
    ('instrument_missing', 'NOT listed', "''"),
    ('instrument_file', 'listed AND f IS DISTINCT FROM file', 'f'),
    ('instrument_version', 'listed AND v IS DISTINCT FROM wanted', 'v'),
    ('instrument_hash_form', 'listed AND NOT formed', "''"),
    ('instrument_hash_unrecognised',
     "formed AND NOT (key = 'gate' AND sha IN (repeat('ab', 32), repeat('ef', 32)))", 'sha'),
    ('instrument_bytes_missing', 'formed AND seen IS NULL', "''"),
    ('instrument_bytes_differ', 'formed AND seen <> sha', 'seen'),
], 'key', 'j')}
UNION ALL {findings('MANIFEST', [
    ('binding_schema', "value ->> '$.schema_version' <> '1.0'", "''"),
    ('bound_date_invalid', "value ->> '$.bound_date' = 'soon'", "''"),
], "''", "c WHERE state = 'ok' AND").replace("AND WHERE", "AND")}""")

WIDE = ["fx_wide_decisions"]
_wide_digest = ("sha256(concat_ws(chr(31), decision_id, '', '', "
                + ", ".join(strip(c) for c in ("chosen", "alternatives", "rationale", "decided_date",
                                               "decided_by")) + ", ''))")
REVIEWED = f"""{FIRST.format(src='fx_wide_decisions')},
f AS (SELECT *, substr(project_id, 2)::BIGINT AS n, {_wide_digest} AS digest,
 row_no % 13 = 0 AS bad FROM first WHERE decision_id IN ({_review})),
p AS (SELECT DISTINCT project_id, substr(project_id, 2)::BIGINT AS n, 0::BIGINT AS row_no FROM fx_wide_decisions)"""
add("review_stale", WIDE, f""", {REVIEWED}, q AS (SELECT * REPLACE (0::BIGINT AS row_no), row_no AS r FROM f)
{findings('SCOPE_REVIEW', [
    ('digest_form', 'bad', "''"), ('digest_stale', 'NOT bad AND r % 5 = 0', 'digest'),
    ('reviewer_is_maker', 'NOT bad AND n % 7 <> 0 AND n % 3 = 1 AND r % 4 = n % 5', "''"),
    ('review_before_decision', "NOT bad AND n % 23 <> 0 AND decided_date > '1996-06-15'", 'decided_date'),
], 'decision_id', 'q')}""")
_checks = "u(i, name) AS (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(fixed.REVIEW_CHECKS)) + ")"
CHECKED = f"""{_checks}, k AS (SELECT p.*, i, name, n % (i + 2) = 0 AS failed, n % 17 = i AS odd, n % 11 = i AS mute
 FROM p CROSS JOIN u WHERE project_id IN (SELECT project_id FROM f)),
e AS (SELECT project_id, n, row_no, count(*) FILTER (failed) AS fails,
 coalesce(string_agg(name, ', ' ORDER BY name) FILTER (failed), '') AS names FROM k GROUP BY ALL),
ids AS (SELECT project_id, n, 0::BIGINT AS row_no, count(*) AS ids, string_agg(decision_id, ', ' ORDER BY decision_id) AS seen
 FROM f GROUP BY ALL)"""
add("review_record_findings", WIDE, f""", {REVIEWED}, {CHECKED}
{findings('SCOPE_REVIEW', [('record_missing', 'project_id NOT IN (SELECT project_id FROM f)', "''")], "''", 'p')}
UNION ALL {findings('SCOPE_REVIEW', [
    ('schema_invalid', 'n % 19 = 0', "''"), ('reviewer_not_comparable', 'n % 7 = 0', "''"),
    ('date_not_iso', 'n % 23 = 0', "'later'"), ('reviewed_ids_differ', 'ids < 7', 'seen')], "''", 'ids')}
UNION ALL {findings('SCOPE_REVIEW', [('check_result_invalid', 'odd AND NOT failed', 'name'),
                                     ('check_note_empty', 'mute', 'name')], "''", 'k')}
UNION ALL {findings('SCOPE_REVIEW', [('reviewed', 'true', "'exceptional=' || fails")], "''", 'e',
                    notes=('reviewed',))}""")
add("approval_findings", WIDE, f""", {REVIEWED}, {CHECKED},
scope AS (SELECT project_id, count(DISTINCT decision_id) FILTER (decision_id IN ({_scope})) = 10
 AND count(*) = count(DISTINCT decision_id) AS whole,
 bool_or(decision_id IN ({_scope}) AND row_no % 4 = 3) AS run3 FROM fx_wide_decisions GROUP BY project_id),
a AS (SELECT p.*, e.fails, e.names, e.project_id IS NOT NULL AS reviewed, whole, run3, p.n % 29 <> 0 AS ok,
 CASE WHEN p.n % 5 = 0 THEN NULL WHEN e.fails > 0 THEN 'exceptions_present'
  WHEN p.n % 31 = 0 THEN 'policy_missing' WHEN p.n % 5 = 1 AND p.n % 3 = 0 THEN 'not_delegated'
  WHEN p.n % 5 = 1 THEN NULL WHEN p.n % 5 = 4 THEN 'approver_not_comparable'
  WHEN e.project_id IS NULL THEN 'review_missing'
  WHEN p.n % 5 = 3 AND p.n % 7 <> 0 THEN 'approver_is_reviewer'
  WHEN p.n % 5 = 3 AND p.n % 3 = 1 AND run3 THEN 'approver_made_scope' END AS defect,
 CASE WHEN p.n % 2 = 0 THEN 'q3_disconfirms_q2' ELSE '' END AS accepted
 FROM p LEFT JOIN e USING (project_id) JOIN scope USING (project_id))
{findings('SCOPE_APPROVAL', [
    ('record_missing', 'NOT ok', "''"), ('approver_refused', 'ok AND defect IS NOT NULL', 'defect'),
    ('not_proceeding', 'ok AND n % 9 = 0', "'hold'"),
    ('reference_untraceable', 'ok AND n % 10 = 0', "'no_date'"),
    ('bound_unresolved', 'ok AND NOT whole', "'decisions.csv#question_scope'"),
    ('bound_stale', 'ok AND whole', "'decisions.csv#question_scope'"),
    ('bound_stale', 'ok AND n % 6 = 0', "'feasibility.csv'"),
    ('accepted_set_differs', 'ok AND reviewed AND names <> accepted', 'names'),
    ('approval_before_review', 'ok AND reviewed AND n % 23 <> 0 AND n % 4 = 0', "'1996-06-01'"),
    ('recorded', 'ok', "'decision=' || CASE WHEN n % 9 = 0 THEN 'hold' ELSE 'proceed' END || "
     "' accepted=' || CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END"),
], "''", 'a', notes=('recorded',))}""")
add("project_verdict", [], f"""WITH all_findings AS (
 SELECT project_id, severity FROM ({SQL['decision_findings_v03']})
 UNION ALL SELECT project_id, severity FROM ({SQL['source_findings_v03']})
 UNION ALL SELECT project_id, severity FROM ({SQL['probe_findings']}))
SELECT project_id, count(*) FILTER (severity = 'error') AS errors,
 count(*) FILTER (severity = 'note') AS notes, count(*) FILTER (severity = 'error') = 0 AS passed
FROM all_findings GROUP BY project_id""")

# ---- scans over files Spark derives from the tables ---------------------------------------------

SHELF = """'p' || CAST(floor(row_no / 25) AS BIGINT) AS project_id,
 1 + row_number() OVER (PARTITION BY floor(row_no / 25) ORDER BY row_no) AS row_no"""
add("register_scan", SRC, f""" SELECT {SHELF}, 'source_id,title,publisher,notes' AS header, source_id,
 title || chr(13) || chr(10) || '"x", y' || chr(13) AS title, publisher, notes FROM fx_sources""")
add("register_rows_wide", SRC, f""" SELECT {SHELF}, CAST(90 AS INTEGER) AS columns, CAST(90 AS INTEGER) AS cells,
 'v0,' || row_no AS c0, 'v89,' || (row_no + 89) AS c89 FROM fx_sources""")
add("register_headers", [], """WITH p AS (SELECT DISTINCT CAST(floor(c_custkey / 25) AS BIGINT) AS n FROM customer),
k AS (SELECT 'c' || n AS project_id, n % 6 AS kind, CAST(floor(n / 6) AS BIGINT) % 2 = 0 AS older FROM p),
f AS (SELECT project_id, 'header_differs' AS rule, 'error' AS severity,
  'claim_id,claim_text,source_id,claim_basis,material_to_conclusion,' || CASE WHEN kind = 5 THEN 'uncertainty,' ELSE '' END
  || 'corroborating_source_id,notes' AS detail FROM k WHERE kind IN (3, 5)
 UNION ALL SELECT project_id, 'domain_columns', 'note', concat_ws(', ', CASE WHEN older THEN 'corroborating_source_id' END,
  CASE WHEN kind = 1 THEN 'grid, zone, east' END) FROM k WHERE kind IN (0, 1, 2, 4) AND (older OR kind = 1))
SELECT project_id, 'MANIFEST' AS arm, rule, severity, 'claims.csv' AS subject_id, 0::BIGINT AS row_no, detail FROM f""")
add("candidate_register", [], """SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, p_name || ', "as' || chr(10) || 'named"' AS subject,
 p_brand AS family, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS record,
 CASE WHEN p_partkey % 2 = 0 THEN ' Yes' ELSE 'no' END AS history_bulk,
 CASE WHEN p_partkey % 3 = 0 THEN 'YES' ELSE '' END AS archive_fallback, CAST(p_size AS VARCHAR) AS byte_count,
 '-' AS publication_status, (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0 AS admitted FROM part""")
add("catalogue_rules", [], """WITH v(contract, stops, full_list) AS (VALUES ('v0.1', false, false), ('v0.2', true, true), ('v0.3', true, true)),
c AS (SELECT c_custkey AS k, v.*, k % 19 = 0 AND k % 4 <> 0 AS bare FROM customer, v),
f AS (SELECT 'catalogue_type' AS rule, '' AS subject_id, '' AS detail FROM customer WHERE c_custkey % 7 = 0
 UNION ALL SELECT 'catalogue_default', '', '' FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT 'contract_required', contract, '' FROM c WHERE full_list AND k % 3 = 0
 UNION ALL SELECT 'contract_stages', contract, '' FROM c WHERE stops AND k % 13 = 0
 UNION ALL SELECT 'contract_root', contract, '' FROM c WHERE contract = 'v0.3' AND k % 17 = 0
 UNION ALL SELECT 'hashes_missing', contract, 'gate.bin' FROM c WHERE bare
 UNION ALL SELECT 'hash_form', contract, 'gate.bin' FROM c WHERE k % 4 = 0
 UNION ALL SELECT 'released_bytes_unrecognised', contract, 'gate.bin' FROM c WHERE NOT bare AND k % 2 = 1)
SELECT 'MANIFEST' AS arm, rule, 'error' AS severity, subject_id, detail, count(*) AS n FROM f GROUP BY ALL""")
add("held_files", [], """SELECT source || '-' || CAST(floor(doc_id / 400) AS BIGINT) AS project_id,
 sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS file_sha256 FROM documents GROUP BY ALL""")
add("source_specs", [], """WITH s AS (SELECT url || ':' || CASE WHEN page_id % 3 = 0 THEN 'x'
  ELSE CAST(page_id % 5 AS VARCHAR) END AS spec FROM pages
 UNION ALL SELECT source || '.txt' || CASE WHEN doc_id % 2 = 0 THEN ':' || doc_id % 6 ELSE '' END FROM documents)
SELECT spec, CASE WHEN contains(spec, ':') THEN regexp_replace(spec, ':[^:]*$', '') ELSE spec END AS source_path,
 CASE WHEN regexp_matches(spec, ':[0-9]+$') THEN CAST(regexp_extract(spec, ':([0-9]+)$', 1) AS INTEGER) ELSE 3 END AS tier
FROM s""")
add("delimited_numbers", [], """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
n AS (SELECT 'o' || k || CASE k % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.TSV' ELSE '.txt' END AS name,
 CASE WHEN k % 3 = 1 THEN [k::VARCHAR, c::VARCHAR]
 -- unsplit, the comma between the last two fields groups when the key has one to three digits
 WHEN k % 3 = 2 AND k < 1000 THEN [k::VARCHAR || (100 + c % 900), (7000 + 100 + k % 900)::VARCHAR]
 ELSE [k::VARCHAR, (100 + c % 900)::VARCHAR, (7000 + 100 + k % 900)::VARCHAR] END AS nums FROM o)
SELECT name, unnest(list_distinct(nums)) AS num FROM n""")
add("exit_rates", [], """WITH l AS (SELECT event_type AS grp, user_id, max(CAST(ts AS DATE)) AS last_seen
 FROM events GROUP BY ALL), e AS (SELECT max(CAST(ts AS DATE)) AS edge FROM events),
c AS (SELECT grp, count(*) AS entries, count(*) FILTER (last_seen < edge) AS exits_counted,
 count(*) FILTER (last_seen < edge - 7) AS exits_confirmed FROM l, e GROUP BY grp)
SELECT *, round(100 * exits_counted / entries, 2) AS pct_counted,
 round(100 * exits_confirmed / entries, 2) AS pct_confirmed FROM c""")

# ---- repeated keys, whole arms and report texts -------------------------------------------------

FOLDED = "s AS (SELECT *, 's' || (row_no % 40) AS sid FROM fx_sources)"
add("source_repeats", SRC, f""", {FOLDED}
SELECT 'all' AS project_id, 'SOURCES' AS arm, 'registered_twice' AS rule, 'error' AS severity,
 sid AS subject_id, row_no, '' AS detail FROM s QUALIFY row_number() OVER (PARTITION BY sid ORDER BY row_no) > 1""")
add("source_last_wins", SRC, f""", {FOLDED}
SELECT sid, motive_tier AS tier, retrieval_status AS status, second_source_id AS second, {url_ok('url')} AS reachable
FROM s QUALIFY row_number() OVER (PARTITION BY sid ORDER BY row_no DESC) = 1""")
add("claim_id_repeats", CLM, """, c AS (SELECT string_split(claim_id, '-')[1] AS short,
 string_split(claim_id, '-')[2]::BIGINT AS line, row_no FROM fx_claims),
d AS (SELECT CASE WHEN line % 2 = 0 THEN upper(short) ELSE short END AS id, row_no * 100 + line AS row_no FROM c)
SELECT 'all' AS project_id, 'CLAIMS' AS arm, 'id_used_twice' AS rule, 'error' AS severity, id AS subject_id,
 row_no, '' AS detail FROM d
QUALIFY row_no > min(row_no) OVER (PARTITION BY lower(id))""")
add("probe_repeats", PRB, """, p AS (SELECT project_id, row_no, CASE WHEN row_no % 3 = 0 THEN 'n/a'
 ELSE 'U' || (row_no % 97 + substr(project_id, 2)::BIGINT) END AS id FROM fx_probes),
q AS (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY row_no) AS rn FROM p)
SELECT project_id, 'FEASIBILITY' AS arm, CASE WHEN id = 'n/a' THEN 'id_unusable' ELSE 'recorded_twice' END AS rule,
 'error' AS severity, id AS subject_id, row_no, CASE WHEN id = 'n/a' THEN id ELSE '' END AS detail
FROM q WHERE id = 'n/a' OR rn > 1""")
add("feasibility_findings", [], f"""SELECT * FROM ({SQL['probe_findings']})
UNION ALL SELECT project_id, 'FEASIBILITY', 'no_probes', 'error', '', 0, '' FROM
 (SELECT DISTINCT 'p' || c_custkey % 20 AS project_id FROM customer)
 WHERE project_id NOT IN (SELECT 'p' || user_id % 16 FROM events)
UNION ALL SELECT project_id, 'FEASIBILITY', u.rule, u.severity, '', 0, u.detail FROM ({SQL['probe_coverage']}) c,
 LATERAL (SELECT 'question_not_probed' AS rule, 'error' AS severity, missing AS detail WHERE missing <> ''
  UNION ALL SELECT 'coverage', 'note', 'probes=' || probes || ' questions=' || questions
  UNION ALL SELECT 'all_unknown', 'note', probes::VARCHAR WHERE all_unknown) u
UNION ALL SELECT project_id, 'FEASIBILITY', 'numbers_in_notes', 'note', '', 0, tokens || ': ' || preview
 FROM ({SQL['probe_numeric_preview']})""")
add("approval_digest_block", DEC, f""", {DIGESTS}, s AS ({SCOPE_DIGEST})
SELECT project_id, CASE WHEN scope_digest IS NOT NULL THEN
 '{{"bound_files":{{"decisions.csv#question_scope":"' || scope_digest || '","feasibility.csv":"'
 || sha256(project_id || 'feasibility.csv') || '","scope_review.json":"'
 || sha256(project_id || 'scope_review.json') || '"}}}}' END AS block FROM s""")
add("diff_report", DEC, f""", c AS ({contract('v0.3')}),
last AS (SELECT * FROM fx_decisions QUALIFY row_number() OVER (PARTITION BY run_id, decision_id ORDER BY row_no DESC) = 1),
grid AS (SELECT c.*, r.run_id, l.chosen, l.decided_by, l.alternatives, l.rationale
 FROM c CROSS JOIN (SELECT DISTINCT run_id FROM fx_decisions) r
 LEFT JOIN last l ON l.run_id = r.run_id AND l.decision_id = c.decision_id),
text AS (SELECT *, '- **' || run_id || '** (`' || coalesce(decided_by, 'unspecified') || '`):' || chr(10)
 || '  - *Chosen:* ' || coalesce(chosen, '[empty]')
 || CASE WHEN coalesce(alternatives, '') <> '' THEN chr(10) || '  - *Alternatives:* ' || alternatives ELSE '' END
 || CASE WHEN coalesce(rationale, '') <> '' THEN chr(10) || '  - *Rationale:* ' || rationale ELSE '' END AS line FROM grid),
d AS (SELECT decision_id, stage, question, CASE WHEN count(DISTINCT {strip('chosen')}) = 1 THEN 'CONSENSUS' ELSE 'DIVERGENCE' END AS status,
 CAST(count(*) AS INTEGER) AS runs, string_agg(line, chr(10) ORDER BY run_id) AS lines
 FROM text GROUP BY ALL HAVING bool_or({strip('chosen')} <> ''))
SELECT decision_id, stage, question, status, runs, '## ' || decision_id || ' (' || stage || ': ' || question || ')'
 || chr(10) || '**Status:** ' || status || chr(10) || chr(10) || lines AS markdown FROM d""")
add("diff_lines", DEC, f""", c AS ({contract('v0.3')}), d AS (SELECT *, project_id || '/' || run_id AS run FROM fx_decisions),
last AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run, decision_id ORDER BY row_no DESC) = 1),
grid AS (SELECT c.decision_id, r.run, l.chosen, l.decided_by, l.alternatives, l.rationale
 FROM c CROSS JOIN (SELECT DISTINCT run FROM d) r LEFT JOIN last l ON l.run = r.run AND l.decision_id = c.decision_id),
s AS (SELECT *, min({strip('chosen')}) OVER same AS low, max({strip('chosen')}) OVER same AS high FROM grid
 WINDOW same AS (PARTITION BY decision_id))
SELECT decision_id, CASE WHEN low = high THEN 'CONSENSUS' ELSE 'DIVERGENCE' END AS status, run AS run_id,
 coalesce(decided_by, 'unspecified') AS decided_by, coalesce(chosen, '[empty]') AS chosen,
 coalesce(alternatives, '') AS alternatives, coalesce(rationale, '') AS rationale FROM s WHERE high <> ''""")

SQL["diff_run_folders"] = SQL["diff_lines"].replace("project_id || '/' || run_id", "project_id || '-' || run_id")

# ---- rules about whole registers, candidates and runs -------------------------------------------

_early = """SELECT project_id, '{arm}' AS arm, 'filled_too_early' AS rule, 'error' AS severity, '' AS subject_id, 0::BIGINT AS row_no,
 CAST(count(*) AS VARCHAR) AS detail FROM {rows} WHERE CAST(substr(project_id, 2) AS INTEGER) % 6 < {ord} GROUP BY project_id"""
EARLY = _early.format(arm="SOURCES", rows="fx_sources", ord=2)
add("premature_rows", CLM, f" {EARLY} UNION ALL " + _early.format(
    arm="CLAIMS", rows="(SELECT 'p' || row_no % 16 AS project_id FROM fx_claims)", ord=3))
add("register_presence", SRC, """, p AS (SELECT DISTINCT c_custkey AS n, 'p' || c_custkey AS project_id FROM customer),
s AS (SELECT *, n % 3 = 2 AS missing, n % 3 < 2 AND n % 9 <> 1 AND project_id NOT IN (SELECT project_id FROM fx_sources) AS empty FROM p)
SELECT project_id, CASE WHEN missing AND n % 2 = 1 THEN 'SOURCES' ELSE 'MANIFEST' END AS arm,
 CASE WHEN missing THEN 'register_missing' WHEN n % 6 < 2 THEN 'register_empty_so_far' ELSE 'register_empty' END AS rule,
 CASE WHEN empty AND n % 6 < 2 THEN 'note' ELSE 'error' END AS severity, 'sources.csv' AS subject_id, 0::BIGINT AS row_no, '' AS detail
FROM s WHERE missing OR empty""")
add("candidates_admitted", [], """SELECT p_partkey AS candidate_id, p_partkey % 6 = 0 AS eligible FROM part
WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 5 <> 0""")
add("runner_measures", [], """SELECT user_id AS run_id, count(*) FILTER (event_type = 'click') AS interventions,
 count(*) FILTER (event_type = 'purchase') AS corrections,
 count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS unresolved_anchors FROM events GROUP BY user_id""")
add("findings_landed", DEC + SRC, f" SELECT * FROM ({SQL['decision_findings_v03']}) UNION ALL {EARLY}")
_arms = "\nUNION ALL ".join(f"SELECT project_id, severity FROM ({SQL[name]})" for name in (
    "contract_resolution_findings", "decision_findings_v03", "source_findings_v03", "source_derivation_findings",
    "claim_findings_v03", "vocabulary_findings", "feasibility_findings", "review_record_findings", "approval_findings",
    "draft_findings"))
add("gate_verdict", [], f"""SELECT project_id, count(*) FILTER (severity = 'error') AS errors,
 count(*) FILTER (severity = 'note') AS notes, count(*) FILTER (severity = 'error') = 0 AS passed
FROM ({_arms}) GROUP BY project_id""")
