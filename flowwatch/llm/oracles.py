"""The registered queries of this folder as plain SQL over the same tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = rf"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
sized AS (SELECT kind, id, coalesce(w, []) AS w, len(coalesce(w, [])) AS n FROM words),
item_windows AS (
  SELECT id AS item, least(13, n) AS size, unnest(list_transform(range(1, n - least(13, n) + 2), lambda i: array_to_string(w[i:i + least(13, n) - 1], ' '))) AS win
  FROM sized WHERE kind = 'i' AND n > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id, size, unnest(range(1, n - size + 2)) AS pos, unnest(list_transform(range(1, n - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM sized, sizes WHERE kind = 'd' AND n >= size),
met AS (SELECT d.id, d.pos, d.size, i.item FROM doc_windows d JOIN item_windows i USING (size, win)),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT id, pos, size FROM met)) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM met) GROUP BY id)
SELECT s.id AS doc_id, CAST(s.n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= s.n AS contaminated
FROM sized s LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE s.kind = 'd'"""

SQL["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, contains(url, '://') AS whole FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '\.$', ''), '^(www|m)\.', '') AS h,
         regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '(\.html?|/+)$', '') AS p,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN
           ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS q FROM cut),
named AS (SELECT *, CASE WHEN whole THEN h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS address FROM parts),
shared AS (SELECT address FROM named WHERE address IS NOT NULL GROUP BY address HAVING count(*) > 1),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv FROM named, rules
         WHERE whole AND (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.rv, CASE WHEN s.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       s.address IS NOT NULL AS listed
FROM named n LEFT JOIN best b USING (page_id) LEFT JOIN shared s USING (address)"""

SQL["op7_line_frequency"] = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM cut WHERE len(w) >= 3),
twice AS (SELECT doc_id, pos FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, host, md5(t) AS k, len(w) AS total, unnest(l) AS line, unnest(range(len(l))) AS place FROM cut),
short AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
                 regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '0+', '0', 'g') AS norm FROM lines),
often AS (SELECT host, norm FROM short WHERE nw > 0 GROUP BY host, norm HAVING count(DISTINCT k) > 10),
places AS (SELECT DISTINCT host, k, total, place, norm, nw FROM short JOIN often USING (host, norm) WHERE nw > 0),
copies AS (SELECT host, k AS copy FROM places GROUP BY host, k, total HAVING 2 * sum(nw) > total),
shown AS (SELECT s.host, s.norm, c.copy FROM (SELECT DISTINCT host, norm, k FROM places WHERE nw > 25) s LEFT JOIN copies c ON c.host = s.host AND c.copy = s.k),
above AS (
  SELECT DISTINCT host, norm FROM places WHERE nw <= 25
  UNION ALL
  SELECT host, norm FROM shown GROUP BY host, norm HAVING count(*) - count(copy) + least(count(copy), 1) > 10),
gone AS (SELECT host, k, sum(nw) AS n FROM places JOIN above USING (host, norm) GROUP BY host, k),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM short WHERE nw > 0 GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM cut LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone ON gone.host = cut.host AND gone.k = md5(cut.t))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept FROM counts"""


def _part(column: str) -> str:
    """A field of a leaf: its UTF-8 size, a colon and the value, or - for null."""
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_part(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""

#: Trees by language level by level, the tree of their roots, and each leaf's way up, with its siblings' digests and its own fold.
SQL["op11_merkle_manifest"] = f"""WITH RECURSIVE leaves AS (
  SELECT *, coalesce('x' || lang, '') AS g, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS again
  FROM documents), placed AS (
  SELECT doc_id, g, leaf, coalesce(again, leaf) AS again, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM leaves), tree AS (
  SELECT g, 0 AS level, i, leaf AS h, n FROM placed
  UNION ALL
  SELECT g, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY g, i // 2), subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1), above AS (
  SELECT 0 AS level, i, h, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM above WHERE n > 1 GROUP BY i // 2), up AS (
  SELECT doc_id, g, leaf, i AS row, i, 0 AS level, again AS now, '' AS proof FROM placed
  UNION ALL
  SELECT u.doc_id, u.g, u.leaf, u.row, u.i // 2, u.level + 1,
    sha256(CASE WHEN u.i % 2 = 1 THEN o.h ELSE '' END || u.now || CASE WHEN u.i % 2 = 0 THEN coalesce(o.h, '') ELSE '' END), u.proof || coalesce(o.h, '')
  FROM up u JOIN (SELECT DISTINCT g, level, n FROM tree) s ON s.g = u.g AND s.level = u.level AND s.n > 1
  LEFT JOIN tree o ON o.g = u.g AND o.level = u.level AND o.i = xor(u.i, 1)), arrived AS (
  SELECT u.doc_id, u.g, u.leaf, u.row, r.h AS subroot, r.i, 0 AS level, u.now, u.proof
  FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY g, row ORDER BY level DESC) = 1) u JOIN subroots r ON r.g = u.g
  UNION ALL
  SELECT u.doc_id, u.g, u.leaf, u.row, u.subroot, u.i // 2, u.level + 1,
    sha256(CASE WHEN u.i % 2 = 1 THEN o.h ELSE '' END || u.now || CASE WHEN u.i % 2 = 0 THEN coalesce(o.h, '') ELSE '' END), u.proof || coalesce(o.h, '')
  FROM arrived u JOIN (SELECT DISTINCT level, n FROM above) s ON s.level = u.level AND s.n > 1
  LEFT JOIN above o ON o.level = u.level AND o.i = xor(u.i, 1))
SELECT doc_id, leaf, subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = (SELECT h FROM above WHERE n = 1) AS verified
FROM (SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY g, row ORDER BY level DESC) = 1)"""
