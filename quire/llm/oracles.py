"""DuckDB SQL of the queries that SQL can express, by the definitions and without indexes. Ids are taken to be unique, as in the tables the SQL runs on."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_VISIBLE = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

#: Components: the smallest id that a path of links reaches.
_REACH = """reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT item_id, k, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 2))) AS k FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win)),
hits AS (SELECT doc_id, p, k, places.n, item_id FROM places JOIN win ON win.n = places.n AND win.s = array_to_string(w[p:p + places.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id),
runs AS (SELECT doc_id, item_id::VARCHAR AS item, n + max(p) - min(p) AS words, min(p) - 1 AS doc_word, min(k) - 1 AS item_word FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - k ORDER BY p) AS island FROM hits) GROUP BY doc_id, item_id, n, p - k, island),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, doc_word, item, item_word) = 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
words::BIGINT AS longest_words, doc_word::BIGINT AS longest_doc_word, item AS longest_item_id, item_word::BIGINT AS longest_item_word FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
{_REACH}, counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN counts ON counts.id = vec_id LEFT JOIN parts ON parts.id = vec_id"""

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_VISIBLE.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN parts ON parts.id = d.doc_id"""

_NORMAL = "lower(trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
_INTRODUCES = "(?i)(wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\\s*:\\s*$"

QUOTATIONS = f"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
cut AS (SELECT r, conv_id, turn, string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n') AS ls FROM m),
ln AS (SELECT r, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
lv AS (SELECT r, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^( {{0,3}}>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^( {{0,3}}>)+ ?', '') AS line FROM ln),
nb AS (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY pos) AS prev, coalesce(lead(level) OVER (PARTITION BY r ORDER BY pos), 0) AS nxt FROM lv),
g AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM nb),
own AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[ \\t]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS para FROM g WHERE level = 0 AND NOT (nxt > 0 AND regexp_matches(line, '{_INTRODUCES}'))),
runs AS (SELECT r, conv_id, turn, run, level, string_agg(line, ' ' ORDER BY pos) AS line FROM g GROUP BY ALL),
quoted AS (SELECT conv_id, turn, r, run, level, {_NORMAL.format('line')} AS u FROM g WHERE level > 0 UNION SELECT conv_id, turn, r, run, level, {_NORMAL.format('line')} FROM runs WHERE level > 0),
said AS (SELECT conv_id, turn, {_NORMAL.format('line')} AS u FROM g WHERE level = 0 UNION SELECT conv_id, turn, {_NORMAL.format('line')} FROM runs WHERE level = 0
    UNION SELECT conv_id, turn, {_NORMAL.format("string_agg(line, ' ' ORDER BY pos)")} FROM own GROUP BY r, conv_id, turn
    UNION SELECT conv_id, turn, {_NORMAL.format("string_agg(line, ' ' ORDER BY pos)")} FROM own GROUP BY r, conv_id, turn, para),
origin AS (SELECT conv_id, u, min(turn) AS origin FROM said WHERE u <> '' GROUP BY ALL),
found AS (SELECT q.conv_id, q.turn, r, run, level, length(q.u) AS n, origin FROM quoted q JOIN origin o ON o.conv_id = q.conv_id AND o.u = q.u WHERE origin < q.turn),
votes AS (SELECT conv_id, turn, level, origin, sum(n) AS w FROM found GROUP BY ALL),
replies AS (SELECT conv_id, turn, origin AS reply_to FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, w DESC, origin DESC) = 1),
chain AS (SELECT conv_id, turn, reply_to AS thread, 1::BIGINT AS depth FROM replies UNION ALL SELECT c.conv_id, c.turn, p.reply_to, c.depth + 1 FROM chain c JOIN replies p ON p.conv_id = c.conv_id AND p.turn = c.thread),
roots AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
linked AS (SELECT conv_id, turn, count(DISTINCT run) AS n_linked FROM found GROUP BY ALL),
nq AS (SELECT r, count(*) AS n_quotes FROM runs WHERE level > 0 GROUP BY r),
bodies AS (SELECT r, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS body FROM own GROUP BY r)
SELECT m.conv_id, m.turn, role, reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
CASE WHEN n_quotes IS NULL THEN coalesce(text, '') ELSE coalesce(body, '') END AS body
FROM m LEFT JOIN replies USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn) LEFT JOIN linked USING (conv_id, turn) LEFT JOIN nq USING (r) LEFT JOIN bodies USING (r)"""

#: The same over conversations that quote: a turn quotes the one or two before.
QUOTED = QUOTATIONS.replace("WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations)", """WITH RECURSIVE quoting AS (SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 3
WHEN 1 THEN 'They wrote:' || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || c.text
WHEN 2 THEN '> > ' || replace(b.text, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || c.text END, c.text) AS text
FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM quoting)""")

ORACLES = {"op1_quotation_linking": QUOTATIONS, "quoted_conversations": QUOTED, "op3_decontamination": DECONTAMINATION, "op4_embeddings": EMBEDDINGS, "op10_minhash": MINHASH}
