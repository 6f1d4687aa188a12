"""DuckDB SQL for the results of the queries that SQL can express, written from the contracts by brute force."""

# every pair of distinct texts that shares an n-gram is compared; components by a recursive query
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM words
), sets AS (
  SELECT doc_id, md5(array_to_string(list_sort(g), chr(10))) AS k, g, len(g) AS n FROM grams WHERE len(g) > 0
), one AS (SELECT k, count(*) AS copies, min(doc_id) AS least, any_value(g) AS g, any_value(n) AS n FROM sets GROUP BY k),
ex AS (SELECT k, n, unnest(g) AS x FROM one),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS s, any_value(a.n) AS na, any_value(b.n) AS nb
           FROM ex a JOIN ex b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
link AS MATERIALIZED (SELECT a, b FROM shared WHERE 10 * s >= 8 * (na + nb - s) UNION ALL SELECT b, a FROM shared WHERE 10 * s >= 8 * (na + nb - s)),
reach(k, to_k) AS (SELECT a, b FROM link UNION SELECT r.k, l.b FROM reach r JOIN link l ON l.a = r.to_k),
class_of AS (SELECT o.k, least(o.least, coalesce(min(p.least), o.least)) AS class_id FROM one o LEFT JOIN reach r ON r.k = o.k LEFT JOIN one p ON p.k = r.to_k GROUP BY o.k, o.least),
links AS (SELECT l.a AS k, sum(o.copies) AS n FROM link l JOIN one o ON o.k = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(o.copies - 1, 0) + coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN one o ON o.k = s.k LEFT JOIN class_of c ON c.k = s.k LEFT JOIN links l ON l.k = s.k
"""

# water filling by the sorted levels at which sources are full, then one running sum a source
SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[!-+/:-@\[-`{-~]')) AS odd FROM documents
), drawn AS (
  SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
    / greatest(0.05, CASE WHEN size > 0 THEN CAST(size - odd AS DOUBLE) / size ELSE 1 END) AS k FROM sized
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM drawn GROUP BY source
), full_at AS (SELECT *, 2.0 * s / w AS f FROM src WHERE s > 0),
lv AS (
  SELECT f, (1.5 * (SELECT sum(s) FROM src) - coalesce(sum(2.0 * s) OVER below, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS l
  FROM full_at WINDOW below AS (ORDER BY f, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, s, CASE WHEN s = 0 THEN 0.0 ELSE CAST(least(w * (SELECT max(l) FROM lv WHERE l <= f), 2.0 * s) AS DOUBLE) END AS t FROM src
), run AS (
  SELECT d.*, g.s, g.t, CASE WHEN g.s > 0 THEN floor(g.t / g.s) ELSE 0 END AS e,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM drawn d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), fit AS (SELECT *, size > 0 AND r <= t - e * s AS fits FROM run),
gap AS (SELECT *, t - e * s - coalesce(max(CASE WHEN fits THEN r END) OVER (PARTITION BY source), 0) AS g FROM fit),
near AS (SELECT *, CASE WHEN NOT fits AND size > 0 AND size < 2 * g THEN row_number() OVER (PARTITION BY source, NOT fits AND size > 0 AND size < 2 * g ORDER BY abs(size - g), k, doc_id) END AS n FROM gap)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, t AS target,
  CAST(size * (e + CASE WHEN fits OR n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM near
"""

URL_FILTER = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, x.h || x.p AS rule, coalesce(x.v, 'allow') AS verdict FROM parts LEFT JOIN LATERAL (
  SELECT h, p, v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY len(h) DESC, len(p) DESC LIMIT 1) x ON true
"""

# every pair of equal label is compared
EMBEDDINGS = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), link AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach(r, to_r) AS (SELECT a, b FROM link UNION SELECT p.r, l.b FROM reach p JOIN link l ON l.a = p.to_r),
c AS (SELECT p.r, min(t.vec_id) AS low FROM reach p JOIN v t ON t.r = p.to_r GROUP BY p.r),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
  coalesce(v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)), false) AS kept
FROM v LEFT JOIN c ON c.r = v.r LEFT JOIN n ON n.r = v.r
"""


def license_scan(templates: list[tuple[str, str]]) -> str:
    """Every unit against every template; the coefficient alone decides."""
    words = lambda x: f"string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    return rf"""
WITH tpl AS (SELECT name, {pairs} AS g FROM (SELECT name, {words('t')} AS w FROM (VALUES {values}) v(name, t))),
split AS (
  SELECT doc_id, 'line' AS kind, regexp_split_to_array(text, '\r\n|[\n\r]') AS a FROM documents UNION ALL
  SELECT doc_id, 'paragraph', regexp_split_to_array(text, '(?:\r\n|[\n\r])[ \t]*(?:\r\n|[\n\r])\s*') FROM documents
), unit AS (SELECT doc_id, kind, unnest(range(1, len(a) + 1)) AS unit_no, unnest(a) AS u FROM split),
sets AS (SELECT doc_id, kind, unit_no, {pairs} AS g FROM (SELECT *, {words('u')} AS w FROM unit WHERE kind = 'line' OR regexp_matches(u, '\S\s*[\n\r]\s*\S'))),
scored AS (SELECT doc_id, kind, unit_no, name, 2 * len(list_intersect(s.g, t.g)) / CAST(len(s.g) + len(t.g) AS DOUBLE) AS dice FROM sets s JOIN tpl t ON len(s.g) BETWEEN 1 AND 400)
SELECT doc_id, kind, CAST(unit_no AS INTEGER) AS unit_no, arg_max(name, (dice, -rank)) AS license, max(dice) AS dice
FROM (SELECT *, dense_rank() OVER (ORDER BY name) AS rank FROM scored WHERE dice >= {0.8}) GROUP BY doc_id, kind, unit_no
"""


def warc(fields: dict[str, str], where: str, permitted: list[str]) -> str:
    """Each revisit against all responses of its canonical URL."""
    part = lambda k: rf"regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?', {k})"
    allowed = ", ".join(f"'{p}'" for p in permitted)
    headers = "[{'k': 'etag', 'v': etag}, {'k': 'last-modified', 'v': modified}, {'k': 'content-length', 'v': length}, {'k': 'expires', 'v': expires}, {'k': 'cache-control', 'v': control}]"
    return rf"""
WITH rec AS (SELECT html, {", ".join(f"{e} AS {n}" for n, e in fields.items())} FROM (SELECT p.*, k FROM pages p, range(4) t(k)) WHERE {where}),
c AS (
  SELECT *, list_filter({headers}, lambda e: e.v IS NOT NULL) AS h,
    regexp_replace(lower({part(1)}), '^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$', '', 'g') || regexp_replace({part(2)}, '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split({part(3)}, '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(?:utm_[a-z]+|fbclid|gclid|ref)='))), '&') AS q FROM rec
), d AS (SELECT *, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS canonical FROM c),
j AS (
  SELECT v.record_id, v.canonical, v.h, v.etag, v.modified, arg_max(r.record_id, (r.seconds, r.record_id)) AS refers_to
  FROM d v LEFT JOIN d r ON r.kind = 'response' AND r.canonical = v.canonical AND r.seconds < v.seconds WHERE v.kind = 'revisit' GROUP BY ALL
), s AS (
  SELECT j.*, r.h AS rh, r.html, CASE WHEN refers_to IS NULL THEN 'orphan'
    WHEN j.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN replace(j.etag, 'W/', '') = replace(r.etag, 'W/', '') THEN 'resolved' ELSE 'stale' END
    WHEN j.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN j.modified = r.modified THEN 'resolved' ELSE 'stale' END ELSE 'unverified' END AS state
  FROM j LEFT JOIN d r ON r.record_id = refers_to
), m AS (SELECT *, list_filter(h, lambda e: list_contains([{allowed}], e.k)) AS up FROM s)
SELECT record_id, canonical, state, refers_to, CASE WHEN state = 'resolved' THEN array_to_string(list_sort(list_transform(
    list_concat(up, list_filter(rh, lambda e: NOT list_contains(list_transform(up, lambda u: u.k), e.k))), lambda e: e.k || ': ' || e.v)), chr(10)) END AS headers,
  CASE WHEN state = 'resolved' THEN length(html) END AS payload_chars, CASE WHEN state = 'resolved' THEN md5(html) END AS payload_md5 FROM m
"""
