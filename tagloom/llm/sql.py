"""DuckDB SQL of the operators that SQL can express, by brute force over all pairs or lines."""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id AS conv, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS raw FROM conversations),
l AS (SELECT k, conv, turn, i, raw[i] AS line, length(regexp_replace(regexp_extract(raw[i], '^[\x20\x09]*(>[\x20\x09]*)+', 0), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(raw[i], '^[\x20\x09]*(>[\x20\x09]*)+', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM m)),
q AS (SELECT conv, turn, norm, min(level) AS level, count(*) AS n FROM l WHERE level > 0 AND norm <> '' AND conv IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
o AS (SELECT q.conv, q.turn, q.norm, q.level, q.n, max(w.turn) AS origin FROM q JOIN l w ON w.conv = q.conv AND w.norm = q.norm AND w.level = 0 AND w.turn < q.turn GROUP BY ALL),
g AS (SELECT k, conv, turn, i, norm, CASE WHEN norm = '' THEN -1 ELSE level END AS lev FROM l),
f AS (SELECT *, i - row_number() OVER (PARTITION BY k, lev ORDER BY i) AS island FROM g),
y AS (SELECT k, conv, turn, lev AS level, string_agg(norm, ' ' ORDER BY i) AS t, list(norm) AS norms, count(*) AS n FROM f WHERE conv IS NOT NULL AND turn IS NOT NULL GROUP BY k, conv, turn, lev, island),
a AS (SELECT y.conv, y.turn, t, min(level) AS level, sum(n) AS n FROM y WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.conv = y.conv AND o.turn = y.turn AND list_contains(y.norms, o.norm)) GROUP BY ALL),
w AS (SELECT conv, turn, t FROM y WHERE level = 0 AND n > 1 UNION SELECT conv, turn, norm FROM l WHERE level = 0 AND norm <> ''),
e AS (SELECT conv, turn, level, n, origin FROM o UNION ALL SELECT a.conv, a.turn, a.level, a.n, max(w.turn) FROM a JOIN w ON w.conv = a.conv AND w.t = a.t AND w.turn < a.turn GROUP BY a.conv, a.turn, a.t, a.level, a.n),
v AS (SELECT conv, turn, origin, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS direct, sum(n) AS n FROM e GROUP BY ALL),
p AS (SELECT conv, turn, arg_max(origin, {'d': direct, 'n': n, 'o': origin}) AS parent, sum(n) AS n_linked FROM v GROUP BY ALL),
up AS (SELECT conv, turn, parent AS node, 1 AS depth FROM p UNION ALL SELECT up.conv, up.turn, p.parent, depth + 1 FROM up JOIN p ON p.conv = up.conv AND p.turn = up.node),
r AS (SELECT conv, turn, arg_max(node, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
b AS (SELECT k, conv, turn, count(*) FILTER (level > 0) AS n_quoted, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^([\x20\x09]*\r?\n)+', ''), '(\r?\n[\x20\x09]*)+$', '') AS body FROM l GROUP BY ALL),
z AS (SELECT b.conv AS conv_id, b.turn, m.role, body, n_quoted, coalesce(p.n_linked, 0)::BIGINT AS n_linked, p.parent AS parent_turn, coalesce(r.root, b.turn) AS thread_turn, coalesce(r.depth, 0)::BIGINT AS depth, '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || body AS formatted
  FROM b JOIN m ON m.k = b.k LEFT JOIN p ON p.conv = b.conv AND p.turn = b.turn LEFT JOIN r ON r.conv = b.conv AND r.turn = b.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN rank() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY thread_turn, turn) END AS position FROM z"""

OP4 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT k AS id, k AS at FROM v UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.at),
c AS (SELECT r.id AS k, min(w.vec_id) AS component FROM r JOIN v w ON w.k = r.at GROUP BY r.id)
SELECT vec_id, (SELECT count(*) FROM s WHERE s.a = v.k) AS n_links, component AS component_id, coalesce(vec_id = component, true) AS kept FROM v JOIN c ON c.k = v.k"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
c AS (SELECT array_to_string(w, ' ') AS t, min(doc_id) AS class_id, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY 1),
h AS (SELECT t, array_to_string(w[i:i + 4], ' ') AS g, count(*) AS n FROM (SELECT t, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM c) GROUP BY ALL),
z AS (SELECT t, sum(n) AS z FROM h GROUP BY t),
o AS (SELECT a.t AS a, b.t AS b, sum(least(a.n, b.n)) AS o FROM h a JOIN h b ON a.g = b.g AND a.t <> b.t GROUP BY ALL),
s AS (SELECT a, b FROM o JOIN z x ON x.t = a JOIN z y ON y.t = b WHERE o >= 0.8 * (x.z + y.z - o)),
r AS (SELECT t, t AS at FROM c UNION SELECT r.t, s.b FROM r JOIN s ON s.a = r.at),
m AS (SELECT r.t, min(c.class_id) AS component FROM r JOIN c ON c.t = r.at GROUP BY r.t)
SELECT doc_id, CASE WHEN len(d.w) = 0 THEN doc_id ELSE class_id END AS class_id, CASE WHEN len(d.w) = 0 THEN doc_id ELSE component END AS component_id, coalesce(doc_id = CASE WHEN len(d.w) = 0 THEN doc_id ELSE component END, true) AS kept
FROM d LEFT JOIN c ON c.t = array_to_string(d.w, ' ') AND len(d.w) > 0 LEFT JOIN m ON m.t = c.t"""

ORACLES = {"op2_quotation_linking": OP2, "op4_pivot_index": OP4, "op10_bagminhash": OP10}
