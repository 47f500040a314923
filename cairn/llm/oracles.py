"""DuckDB SQL for the queries that SQL can express."""

_DOC_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM r
      WINDOW o AS (ORDER BY cap / weight, weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, weight, source NULLS LAST LIMIT 1), 1e300)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, CAST(floor(q.target) AS BIGINT) - q.whole * q.source_size AS quota,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, quota - (upto - size))) AS BIGINT) AS taken FROM c
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, w[s:s + 4] AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT * FROM (WITH RECURSIVE reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.b) SELECT * FROM reach))
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (rid)
JOIN (SELECT a, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY a) m ON m.a = d.rid
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_DOC_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_DOC_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, w[s:s + 12] AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(gram) AS k FROM g),
p AS (SELECT rid, k, s, w[s:s + k - 1] AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, n WHERE len(w) >= k)),
h AS (SELECT p.rid, p.s, p.k, g.item FROM p JOIN g ON p.gram = g.gram),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS pos FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10 = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n,
             length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\n')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN 7 + n ELSE 14 + r + n END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total::HUGEINT + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total::HUGEINT + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
v AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM f WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_TREE = """{0}(tree, level, pos, node, n) AS (SELECT tree, 0::BIGINT, pos, node, count(*) OVER (PARTITION BY tree) FROM {1}
  UNION ALL SELECT tree, any_value(level) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {0} WHERE n > 1 GROUP BY tree, pos // 3)"""
_STEPS = """SELECT b.rid, {2} AS k, string_agg(u.node, '' ORDER BY u.pos) FILTER (WHERE u.pos < b.pos // CAST(pow(3, u.level) AS BIGINT)) AS l,
  string_agg(u.node, '' ORDER BY u.pos) FILTER (WHERE u.pos > b.pos // CAST(pow(3, u.level) AS BIGINT)) AS r
  FROM {1} b JOIN {0} u ON u.tree = b.tree AND u.n > 1 AND u.pos // 3 = b.pos // CAST(pow(3, u.level + 1) AS BIGINT) GROUP BY b.rid, u.level"""

OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, sha256({_FIELDS} || {_FIELD.format('text')}) AS node,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
s AS (SELECT rid, doc_id, coalesce('=' || source, '') AS tree, node, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256({_FIELDS} || {_FIELD.format("replace(text, chr(10), '')")}) ELSE node END AS seen,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d),
{_TREE.format('up', 's')},
o AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
{_TREE.format('over', 'o')},
w AS (SELECT s.rid, o.tree, o.pos FROM s JOIN o ON o.name = s.tree),
steps AS ({_STEPS.format('up', 's', 'u.level')} UNION ALL {_STEPS.format('over', 'w', '100 + u.level')}),
numbered AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) AS k, coalesce(l, '') AS l, coalesce(r, '') AS r FROM steps),
fold(rid, k, node) AS (SELECT rid, 0::BIGINT, seen FROM s UNION ALL SELECT f.rid, f.k + 1, sha256(l || f.node || r) FROM fold f JOIN numbered x ON x.rid = f.rid AND x.k = f.k + 1)
SELECT doc_id, s.node AS leaf, o.node AS subroot, top.node AS root, sha256(coalesce((SELECT string_agg(l || r, '' ORDER BY k) FROM numbered x WHERE x.rid = s.rid), '')) AS proof_sha256,
       last.node AS folded_root, last.node = top.node AS verified
FROM s JOIN o ON o.name = s.tree JOIN (SELECT node FROM over WHERE n = 1) top ON true JOIN (SELECT rid, arg_max(node, k) AS node FROM fold GROUP BY rid) last ON last.rid = s.rid
"""

ORACLES = {"op1_mix_sources": OP1, "op5_near_dup_join": OP5, "op6_decontaminate": OP6, "op8_exact_dedup": OP8, "op10_chat_format": OP10, "op12_source_divergence": OP12, "op13_merkle_manifest": OP13}
