"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
useful AS (SELECT doc_id, n, item FROM items WHERE item IN (SELECT item FROM items GROUP BY item HAVING count(*) > 1)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM useful a JOIN useful b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.seen = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

SQL["op4_line_dedup"] = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
exploded AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, line, pos,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM exploded
), common AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT keyed.*, common.last_id IS NOT NULL AND keyed.doc_id <> common.last_id AS dropped FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

SQL["op8_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
    source_size * 3.0::DOUBLE AS cap
  FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id || ':17')
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - ahead, 0), size) END AS taken
FROM placed
"""

SQL["op9_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""

SQL["op7_embeddings"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS seen FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.seen = l.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id) r USING (vec_id) LEFT JOIN counts c ON c.a = v.vec_id
"""

SQL["op11_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
placed AS (
  SELECT doc_id, t, length(t) AS n, length(t) // 2 AS half,
    coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next_t
  FROM d
), edits AS (SELECT doc_id, n, t, next_t, left(t, n - half) || left(next_t, half) AS e FROM placed),
texts AS (SELECT doc_id, 0 AS kind, t AS x FROM edits UNION ALL SELECT doc_id, 1, e FROM edits UNION ALL SELECT doc_id, 2, next_t FROM edits),
worded AS (
  SELECT doc_id, kind, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts
), hashed AS (
  SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 15)) END AS h
  FROM worded
), low AS (SELECT doc_id, kind, h, list_filter(h, lambda x: x < '200000000000000') AS l FROM hashed),
sketches AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(l) > 0 THEN l WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END)) AS s FROM low
)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.e) AS edited_sha256,
  array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
  CASE WHEN len(a.s) = 0 THEN CAST(len(b.s) = 0 AS DOUBLE) ELSE len(list_intersect(a.s, b.s)) / len(a.s) END AS near_edited,
  CASE WHEN len(a.s) = 0 THEN CAST(len(c.s) = 0 AS DOUBLE) ELSE len(list_intersect(a.s, c.s)) / len(a.s) END AS near_next
FROM edits e JOIN sketches a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN sketches b ON b.doc_id = e.doc_id AND b.kind = 1
  JOIN sketches c ON c.doc_id = e.doc_id AND c.kind = 2
"""

SQL["op3_url_filter"] = r"""
WITH RECURSIVE pages_of AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')
), links AS (  -- absolute ones and those from the root
  SELECT url, if(starts_with(raw, '/'), regexp_extract(url, '^[^:/?#]*://[^/?#]*') || raw, raw) AS link FROM (
    SELECT url, CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*"?[^">]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\shref\s*=\s*"?([^"\s>]*)', 1)
      WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*"?refresh\b') THEN regexp_extract(tag, '(?i)url\s*=\s*([^"\s>]*)', 1) END AS raw FROM tags) WHERE raw <> ''
), ends AS (
  SELECT DISTINCT u, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS host, coalesce(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '') AS path,
    lower(regexp_extract(u, '://([^/?#]*)', 1)) || if(regexp_extract(u, '://[^/?#]*([^#]*)', 1) LIKE '/%', '', '/') || regexp_extract(u, '://[^/?#]*([^#]*)', 1) AS node
  FROM (SELECT url AS u FROM links UNION SELECT link FROM links) WHERE regexp_extract(u, '://([^/?#]*)', 1) <> ''
), edges AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN ends a ON a.u = url JOIN ends b ON b.u = link
), reach AS (
  SELECT node, node AS seen FROM ends
  UNION
  SELECT r.node, if(e.a = r.seen, e.b, e.a) FROM reach r JOIN edges e ON r.seen IN (e.a, e.b)
), fits AS (
  SELECT k, arg_max(verdict, length(h) * 100000 + length(p)) AS verdict, arg_max(h || p, length(h) * 100000 + length(p)) AS rule
  FROM (SELECT DISTINCT host || '|' || path AS k, host, path FROM (SELECT host, path FROM pages_of UNION ALL SELECT host, path FROM ends))
    JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
), carried AS (
  SELECT r.node, min(f.verdict) AS verdict FROM reach r JOIN ends e ON e.node = r.seen JOIN fits f ON f.k = e.host || '|' || e.path GROUP BY r.node
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, c.verdict, 'allow') AS verdict
FROM pages_of p LEFT JOIN fits f ON f.k = p.host || '|' || p.path LEFT JOIN (SELECT DISTINCT u, node FROM ends) e ON e.u = p.url LEFT JOIN carried c ON c.node = e.node
"""
