"""DuckDB SQL of the operators that SQL can express, written independently of the Spark plans."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]+"
LOWER_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{WS}'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
l AS (SELECT * FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT *, lower(trim(regexp_replace(line, '{WS}', ' ', 'g'))) AS norm, len(list_filter(regexp_split_to_array(line, '{WS}'), lambda x: x <> '')) AS words FROM l),
h AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY 1),
f AS (SELECT host, norm FROM n JOIN h USING (host) GROUP BY host, norm, host_docs HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.05 * host_docs),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
cut AS (SELECT rid, sum(words)::BIGINT AS n FROM n SEMI JOIN f USING (host, norm) GROUP BY rid),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(cut.n, 0)::BIGINT AS n_line_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN cut USING (rid)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words - n_line_words) * 100 >= n_words * 30 AS kept, n_line_words FROM v"""


def shingles(k: int) -> str:
    """Distinct shingles of rows w(id, w): k words, or all words of a shorter text."""
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"""SELECT DISTINCT id, concat_ws(' ', {parts}) AS s FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})
  UNION ALL SELECT id, concat_ws(' ', len(w)::VARCHAR || ' words:', array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND {k - 1}"""


DECONTAMINATE = rf"""
WITH q AS (WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark) {shingles(5)}),
n AS (SELECT id, count(*) AS n_item FROM q GROUP BY 1),
d AS (WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents) {shingles(5)})
SELECT d.id AS doc_id, q.id AS item_id, n_item, count(*) AS n_shared FROM d JOIN q ON d.s = q.s JOIN n ON n.id = q.id
GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 80 * n_item"""

JACCARD = rf"""
WITH RECURSIVE g AS (WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({LOWER_ASCII.format("coalesce(text, '')")}, '{WS}'), lambda x: x <> '') AS w FROM documents) {shingles(3)}),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.id = a GROUP BY 1, 2"""

SENTENCES = rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?]){WS}', '\1' || chr(10), 'g'), '[\n\r]+'),
    lambda x: lower(trim(regexp_replace(x, '{WS}', ' ', 'g')))), lambda x: x <> '') AS s FROM documents),
c AS (SELECT doc_id, s, list_transform(s, lambda x: len(string_split(x, ' '))) AS c FROM s),
w AS (SELECT doc_id, s, i, list_filter(range(1, 26), lambda m: i + m - 1 <= len(s) AND ((m >= 2 AND list_sum(c[i:i + m - 1]) >= 25) OR (m = 1 AND c[i] >= 50)))[1] AS m
  FROM (SELECT doc_id, s, c, unnest(range(1, len(s) + 1)) AS i FROM c)),
l AS (SELECT doc_id, i - 1 AS place, i - 1 + m AS stop, array_to_string(s[i:i + m - 1], chr(10)) AS k FROM w WHERE m IS NOT NULL AND (m = 1 OR i = 1 OR s[i - 1] <> s[i] OR len(list_distinct(s[i:i + m - 1])) > 1)),
f AS (SELECT *, min((doc_id, place)) OVER (PARTITION BY k) AS first, max((doc_id, place)) OVER (PARTITION BY k) AS last FROM l),
x AS (SELECT doc_id, place, stop, first[1] AS f, CASE WHEN (doc_id, place) = first THEN 'first' ELSE 'repeat' END AS role FROM f WHERE first <> last),
b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, role ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
g AS (SELECT *, sum((place > coalesce(before, -9))::INT) OVER (PARTITION BY doc_id, role ORDER BY place) AS span FROM b)
SELECT doc_id, min(place)::INT AS start, max(stop)::INT AS "end", min(f) AS first_doc_id, role FROM g GROUP BY doc_id, role, span"""

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
MASKED_SQL = "v"
for _length, _part in ((36, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"), (11, "(?i)placeholder"), (10, "(?i)0123456789|abcdefghij"), (8, "(?i)changeme"), (7, "(?i)example"), (5, "(?i)dummy"), (4, "(?i)xxxx")):
    MASKED_SQL = f"regexp_replace({MASKED_SQL}, '{_part}', repeat(' ', {_length}), 'g')"
MASKED_SQL = f"list_reduce(list_prepend({MASKED_SQL}, string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')), lambda x, c: replace(x, repeat(c, 6), '      '))"
SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT rid, 0 AS k, 'assign' AS kind, 6 AS least, regexp_split_to_array(t, '{ASSIGN}') AS g, regexp_extract_all(t, '{ASSIGN}') AS m, regexp_extract_all(t, '{ASSIGN}', 2) AS p FROM d
  UNION ALL SELECT rid, 1, 'access', 20, regexp_split_to_array(t, 'AKIA[A-Z0-9]{{16,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{16,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{16,}}') FROM d
  UNION ALL SELECT rid, 2, 'hex', 24, regexp_split_to_array(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}') FROM d
  UNION ALL SELECT rid, 3, 'entropy', 20, regexp_split_to_array(t, '[A-Za-z0-9+/_=-]{{20,}}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}') FROM d),
x AS (SELECT rid, k, kind, m[i] AS v, list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw) WHERE length(p[i]) >= least),
y AS (SELECT *, s + length(v) AS e, row_number() OVER () AS n FROM x),
base AS (SELECT * FROM y WHERE k < 3),
runs AS (SELECT rid, n, s, {MASKED_SQL} AS mv FROM y WHERE k = 3 AND NOT regexp_matches(v, '^/?[a-z0-9_-]+(/[a-z0-9_-]+){{2,}}/?$')),
part AS (SELECT rid, s AS off, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT *, regexp_extract_all(mv, '[A-Za-z0-9+/_=-]{{20,}}') AS m, regexp_split_to_array(mv, '[A-Za-z0-9+/_=-]{{20,}}') AS g FROM runs)),
left_ AS (SELECT rid, 3 AS k, 'entropy' AS kind, m[i] AS v, off + list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s FROM part),
cand AS (SELECT *, s + length(v) AS e, row_number() OVER () AS n FROM left_ WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = left_.rid AND b.s <= left_.s AND b.e >= left_.s + length(left_.v))),
h AS (SELECT n, i, -sum(c / 20.0 * log2(c / 20.0)) AS bits FROM (
    SELECT n, i, ch, count(*) AS c FROM (SELECT n, i, unnest(string_split(substr(v, i, 20), '')) AS ch FROM (SELECT n, v, unnest(range(1, length(v) - 18)) AS i FROM cand)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
added AS (SELECT cand.rid, cand.k, cand.kind, cand.s, cand.e FROM cand JOIN (SELECT n, max(bits) AS bits FROM h GROUP BY 1) USING (n) WHERE bits >= CASE
  WHEN regexp_matches(v, '^[0-9]+$') THEN 2.7 WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 2.9 WHEN NOT regexp_matches(v, '[0-9]') THEN 3.9
  WHEN regexp_matches(v, '^[0-9a-z]+$') OR regexp_matches(v, '^[0-9A-Z]+$') THEN 3.4 WHEN regexp_matches(v, '^[0-9A-Za-z]+$') THEN 3.65
  WHEN regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') THEN 3.8 ELSE 3.9 END),
b AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, k) AS spans FROM base GROUP BY 1),
a AS (SELECT rid, string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, k) AS spans FROM (SELECT rid, k, kind, s, e FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{WS}'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS letter, 1 << (ascii(o[step]) - 65) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o, step, letter, sum(CASE WHEN mask & bit = 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, m GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""

#: Fixed strings of the template, and what each turn and message adds to the texts.
CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
t AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS begins, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?(INST|ROLE|SYS)|TURN)\]')) AS shown FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(shown) + sum(CASE WHEN begins THEN length('<s>[ROLE]' || role || '[/ROLE]' || '</s>') ELSE length('[TURN]') END))::BIGINT AS formatted_chars, count(*) FILTER (begins)::BIGINT AS n_messages
FROM t GROUP BY conv_id"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS g FROM d),
c AS (SELECT *, least(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS a, greatest(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

SQL = {
    "op2_secret_scan": SECRETS,
    "op1_decontaminate": DECONTAMINATE,
    "op6_sentence_dedup": SENTENCES,
    "op7_quality_rules": QUALITY,
    "op10_jaccard_join": JACCARD,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_chat_format": CHATS,
    "op13_fill_middle": FILL_MIDDLE,
}
