"""The corpus queries in SQL, where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS k FROM g JOIN f USING (win) WHERE f.first < g.doc_id)),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, d.w, coalesce(r.ps, []::BIGINT[]) AS ps FROM d LEFT JOIN r USING (doc_id)),
o AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, ps, unnest(range(1, len(w) + 1)) AS p FROM k) WHERE NOT list_contains(ps, p)),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line FROM o GROUP BY doc_id)
SELECT k.doc_id, k.n_words, len(k.ps)::BIGINT AS n_removed, sha256(coalesce(s.line, '')) AS kept_sha256
FROM k LEFT JOIN s USING (doc_id)
"""

# Texts are written as they are, unless parsing would then differ: with < or > those are escaped, and if the text has
# a backslash before something that parsing would take, or at its end, backslashes too.
OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL),
e AS (
  SELECT *, CASE
    WHEN contains(text, '\') THEN length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g'))
    ELSE length(text) + length(regexp_replace(text, '[^<>]', '', 'g')) END AS written,
    length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) AS role_written
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + role_written + written)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format("text")})::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ((k - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight,
    sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, greatest(total::DOUBLE - capped::DOUBLE, 0) AS rest_words FROM r),
f AS (SELECT place, rest_words, open_weight FROM l WHERE rest_words * weight / open_weight <= cap ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN cap::DOUBLE ELSE f.rest_words * weight / f.open_weight END AS target
  FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t),
q AS (SELECT *, greatest(target - certain * source_size, 0) AS rest FROM p),
o AS (SELECT d.doc_id, d.size, q.*, d.u / (1 - d.u) / sqrt(greatest(d.size, 1)::DOUBLE) AS quotient FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, least(floor(quotient / (1 + quotient) * 65536), 65535) AS step FROM o),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY step, quotient, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach FROM e),
y AS (SELECT *, CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END AS extra FROM x),
z AS (SELECT *, rest - sum(size * extra) OVER (PARTITION BY source) AS room FROM y),
fits AS (SELECT *, extra = 0 AND size > 0 AND size <= room AS fit FROM z),
again AS (SELECT *, sum(CASE WHEN fit THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY step, quotient, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach_again FROM fits),
more AS (SELECT *, CASE WHEN fit AND reach_again <= room THEN 1 ELSE extra END AS drawn FROM again),
g AS (SELECT *, rest - sum(size * drawn) OVER (PARTITION BY source) AS lack FROM more),
b AS (
  SELECT *, CASE WHEN drawn = 0 AND abs(size - lack) < lack THEN
    row_number() OVER (PARTITION BY source ORDER BY CASE WHEN drawn = 0 AND abs(size - lack) < lack THEN 0 ELSE 1 END, abs(size - lack), quotient, doc_id, size) END AS best FROM g)
SELECT doc_id, size, source_size, target, ((certain + drawn + CASE WHEN best = 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM b
"""

_NORMAL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""
WITH d AS (SELECT doc_id, {_NORMAL.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_NORMAL.format("text")} AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
g AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN n WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.n, g.k, v.item_id FROM g JOIN v ON g.win = v.win AND g.n = v.n),
h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
g AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
