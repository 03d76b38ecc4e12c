"""DuckDB SQL for the queries that SQL can express, written independently of the DataFrame code.

Not expressible: the guess costs of op2, the schedule of op3 beyond its rules, XXH64 in op7, token ids in
op8 and the trained model of op10. Their tests hold them against brute force.
"""

from __future__ import annotations

from auditloom.llm import licenses, quality

SPACES = r"[ \t\n\x0B\f\r]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACES}'), lambda w: w <> '')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_CRC_TABLE = """t AS (SELECT list(x ORDER BY k) AS crc FROM (SELECT k, list_reduce([k] || range(8), lambda c, i:
 CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS x FROM range(256) r(k)))"""

OP1 = f"""WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, size, list_transform(range(size - 1), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1)
  + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM d),
c AS (SELECT rid, doc_id, size, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, x:
  xor(c // 256, crc[xor(c % 256, x) + 1]))) AS text_crc32 FROM b, t),
jump(rid, state, now, ahead) AS (
  SELECT rid, CAST(CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0) END AS UHUGEINT), -1::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT rid, next, ahead, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT rid, ahead, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE ahead < 17)),
shards AS (SELECT rid, max(now) FILTER (now < 16) AS shard, max(now) FILTER (now < 17) AS grown FROM jump GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN shards USING (rid)"""

OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5"""


_PUNCTUATION = r"[\x00-/:-@\[-`{-\x7F“”‘’–—…©]+"


def _canonical(text: str) -> str:
    lower = f"lower(coalesce({text}, ''))"
    plain = f"regexp_replace({lower}, '{licenses.COPYRIGHT_LINE.pattern}', chr(10), 'g')"
    plain = f"' ' || regexp_replace({plain}, '{_PUNCTUATION}', ' ', 'g') || ' '"
    for one, other in licenses.SPELLINGS:
        plain = f"replace({plain}, '{one}', '{other}')"
    return f"nullif(trim({plain}, ' '), '')"


_KNOWN = ", ".join(f"('{name}', '{_quoted(text)}')" for name, texts in licenses.KNOWN.items() for text in texts)
OP5 = f"""WITH k AS (SELECT sha256({_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {_KNOWN}) AS k(license, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS notice_lines
 FROM lines JOIN k ON sha256({_canonical('line')}) = digest GROUP BY rid)
SELECT doc_id, sha256({_canonical('text')}) AS text_digest, license, coalesce(notices, '') AS notices, coalesce(notice_lines, 0) AS notice_lines
FROM d LEFT JOIN k ON sha256({_canonical('text')}) = digest LEFT JOIN n USING (rid)"""

OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i:
 array_to_string(w[i:i + 12], ' '))) AS seq FROM d WHERE len(w) >= 13),
dup AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY seq) < doc_id),
gone AS (SELECT rid, list(DISTINCT i + k) AS lost_at FROM dup, range(13) r(k) GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM
 (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) u LEFT JOIN
 (SELECT rid, unnest(lost_at) AS i, true AS lost FROM gone) g USING (rid, i) WHERE lost IS NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lost_at), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""

_RULES = list(quality.CUTOFFS)
_SCORES = {"symbols": "n_symbols / greatest(n_words, 1)", "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
           "repeats": "n_repeat_words / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)"}
_GRID = ", ".join(f"('{rule}', {k}, {c}::DOUBLE)" for rule, grid in quality.CUTOFFS.items() for k, c in enumerate(grid))
_TAIL = """coalesce((SELECT ln(sum(exp(t - m))) + max(m) FROM (SELECT t, max(t) OVER () AS m FROM (SELECT lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
 + j * ln(p) + (n - j) * ln(1 - p) AS t FROM range(x + 1) r(j)) a) b), 0)"""
OP9 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS seq
 FROM d WHERE len(w) >= 8),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, seq) > 1) q, range(8) r(k) GROUP BY rid),
m AS (SELECT rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^ \\t\\n\\x0B\\f\\r]')) AS lines,
 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals, coalesce(rep.n, 0) AS n_repeat_words
 FROM d LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
s AS (SELECT rid, unnest([{', '.join(f"{{'rule': '{r}', 'score': ({_SCORES[r]})::DOUBLE}}" for r in _RULES)}]) AS s FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
g(rule, k, cutoff) AS (VALUES {_GRID}),
counts AS (SELECT stratum, rule, k, cutoff, count(*) AS n, count(*) FILTER (s.score > cutoff) AS x FROM f JOIN s USING (rid)
 JOIN g ON g.rule = s.s.rule WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
tests AS (SELECT *, x < n * p AND {_TAIL} <= ln(0.05 / {len(_RULES)} / (SELECT count(DISTINCT stratum) FROM f)) AS ok
 FROM (SELECT *, {0.02 / len(_RULES)}::DOUBLE AS p FROM counts)),
cuts AS (SELECT stratum, rule, arg_max(cutoff, k) AS cutoff FROM
 (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY k) AS allowed FROM tests) WHERE allowed GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM f JOIN s USING (rid) JOIN cuts ON cuts.stratum = f.stratum AND cuts.rule = s.s.rule WHERE s.s.score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM f"""

_PRINT_BITS = ", ".join(f"sum((h >> {k}) & 1)" for k in range(64))
_PRINT_WIDE = ", ".join(f"sum(('0x' || substr(sha256('{salt}:' || p), {8 * k + 1}, 8))::BIGINT)" for salt in (0, 1) for k in range(8))
_PRINT_ORDER = [f"b[{s + 1 + at}]" for at in (0, 32) for s in range(32)]
_SIGNS = "list_transform({0}[18:81], lambda x: (2 * x - {0}[1])::DOUBLE)"
OP11 = f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS r, doc_id, coalesce(text, '') AS text,
  count(*) OVER () AS total FROM documents),
e AS (SELECT a.r, b.r AS next, a.doc_id, length(a.text) AS n_chars, a.text,
  left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) AS edited FROM d a JOIN d b ON b.r = a.r % a.total + 1),
p AS (SELECT r, edited, unnest(string_split(text, chr(10))) AS p FROM (SELECT r, false AS edited, text FROM e UNION ALL SELECT r, true, edited FROM e)),
wide AS (SELECT r, edited, list_transform([{_PRINT_WIDE}], lambda x: x % 4294967296) AS w FROM p GROUP BY ALL),
blocks AS (SELECT r, edited, ('0x' || left(md5(unnest(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+([ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]+){{0,3}}'))), 16))::UBIGINT AS h FROM p),
bits AS (SELECT r, edited, count(*) AS n, [{_PRINT_BITS}] AS b FROM blocks GROUP BY ALL),
f AS (SELECT r, edited, [coalesce(n, 0)] || list_transform(w, lambda x: x::BIGINT) || CASE WHEN n IS NULL THEN list_resize([]::BIGINT[], 64, 0)
  ELSE list_transform([{', '.join(_PRINT_ORDER)}], lambda x: x::BIGINT) END AS lanes FROM wide LEFT JOIN bits USING (r, edited)),
s AS (SELECT r, edited, lanes, {_SIGNS.format('lanes')} AS v, array_to_string(list_transform(lanes, lambda x: printf('%08x', x)), '') AS hex FROM f),
x AS (SELECT e.r, e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.hex AS fingerprint, b.hex AS edited_fingerprint, a.v, b.v AS ev, c.v AS nv, c.hex AS nhex
  FROM e JOIN s a ON a.r = e.r AND NOT a.edited JOIN s b ON b.r = e.r AND b.edited JOIN s c ON c.r = e.next AND NOT c.edited),
y AS (SELECT *, list_inner_product(v, v) AS vv, list_inner_product(ev, ev) AS ee, list_inner_product(nv, nv) AS nn,
  list_sum(list_transform(list_zip(v, ev), lambda p: (p[1] - p[2]) ** 2)) AS de, list_sum(list_transform(list_zip(v, nv), lambda p: (p[1] - p[2]) ** 2)) AS dn FROM x)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
 CASE WHEN fingerprint = edited_fingerprint THEN 1.0 WHEN vv + ee = 0 THEN 0.0 ELSE greatest(1 - de / (vv + ee), 0.0) END AS near_edited,
 CASE WHEN fingerprint = nhex THEN 1.0 WHEN vv + nn = 0 THEN 0.0 ELSE greatest(1 - dn / (vv + nn), 0.0) END AS near_next FROM y"""

OP12 = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1)
  + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS h FROM c, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pair GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n,
  (SELECT min(near) FROM pair p WHERE p.word = v.word AND p.near_n = best.near_n AND best.near_n >= 10 * v.n) AS form FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = here WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word) USING (word)"""

OP13 = f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, hex(encode(conv_id::VARCHAR)) AS x FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, s.n, s.conv_id - s.conv_id % 20 AS base, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i:
  16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) % 4 AS h FROM s, t_crc),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS kept FROM c LEFT JOIN s b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, p AS pos, role, text FROM k JOIN t ON t.conv_id = k.base AND p <= h
  UNION ALL SELECT k.conv_id, kept + p - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND p > h),
m AS (SELECT conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS words FROM k UNION ALL
  SELECT conv_id, pos, md5(string_agg(turn, ',') OVER w), CASE WHEN pos > 1 THEN md5(string_agg(turn, ',') OVER v) ELSE '' END, words FROM
  (SELECT conv_id, pos, md5(length(role) || ':' || role || text) AS turn, len({_words('text')}) AS words FROM r) z
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos), v AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM m GROUP BY node, depth, parent),
kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
q AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
below AS (SELECT m.node, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n - 1) * q.words) AS saved_tokens
  FROM q JOIN m ON m.conv_id = q.conv_id AND m.depth <= q.depth GROUP BY m.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM
  (SELECT conv_id, node FROM m QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) z GROUP BY node)
SELECT q.conv_id, q.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, q.n::BIGINT AS n_convs, q.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
 saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM q JOIN below USING (node) LEFT JOIN ends USING (node) LEFT JOIN q up ON up.node = q.parent""".replace(
    "t AS (SELECT list(x", "t_crc AS (SELECT list(x")

SQL: dict[str, str] = {"op1_jump_shards": OP1, "op4_exact_topk": OP4, "op5_license_digests": OP5, "op6_anchor_dedup": OP6, "op9_quality": OP9,
                       "op11_multiset_print": OP11, "op12_spelling_variants": OP12,
                       "op13_prefix_trie": OP13}
