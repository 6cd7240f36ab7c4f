"""SQL that must give the rows of the queries whose contract SQL can express; for DuckDB."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
own AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN own USING (g), unnest(range(0, 13)) AS u(k) WHERE first_id < doc_id),
placed AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM d, unnest(range(1, len(w))) AS t(i) WHERE len(w) > 1
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, y FROM edge UNION SELECT a, y FROM reach JOIN edge ON b = x),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, m) AS component_id, doc_id = least(doc_id, m) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

OVERLAPS = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
found AS (SELECT doc_id, i, n, item FROM runs JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM documents, unnest(string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS t(piece)),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM pieces, unnest(range(1, 6)) AS s(m), unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) AS t(i)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE m > 1),
open AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= 100 * c.a
  AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, m, k, string_split(phrase, ' ') AS w FROM open, unnest(range(1, m)) AS t(k)),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n.n,
    (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score FROM best QUALIFY rank <= 2000
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
edge AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT x, y FROM edge UNION SELECT a, y FROM reach JOIN edge ON b = x),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT x AS vec_id, count(DISTINCT y) AS n FROM edge GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, coalesce(vec_id = least(vec_id, m), false) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""

# crc32 bit by bit: a byte enters at every eighth step.
_CRC_IN = "CASE WHEN i % 8 = 0 THEN xor(acc, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE acc END"
TRIE = f"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
ids AS (SELECT c, c::VARCHAR AS s FROM own),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * len(s))),
    lambda acc, i: xor(({_CRC_IN}) >> 1, (({_CRC_IN}) & 1) * 3988292384)), 4294967295) % 4 AS h FROM ids),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.w[1:h], []), a.w[h + 1:]) AS w FROM own a JOIN h USING (c) LEFT JOIN own b ON b.c = a.c - a.c % 20),
pre AS (SELECT c, len(w) AS n, d, w[1:d] AS p FROM rebuilt, unnest(range(0, len(w) + 1)) AS t(d)),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n) AS ends FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
own_node AS (SELECT node.*, coalesce(k, 0) AS k,
  CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node.p[node.d].t, '[^\\x20\\x09-\\x0D]+')) END AS gain
  FROM node LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p),
up AS (SELECT u AS d, p[1:u] AS p, sum((k = 0)::BIGINT) AS leaves, sum(gain) AS saved FROM own_node, unnest(range(0, d + 1)) AS t(u) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM own_node v JOIN up ON up.d = v.d AND up.p = v.p LEFT JOIN node a ON a.d = v.d - 1 AND a.p = v.p[1:v.d - 1]
"""
