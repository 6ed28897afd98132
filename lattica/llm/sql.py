"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All 200-byte strings, their counts, the bytes they cover as islands, and what lies between the islands. Texts are
#: handled as hexadecimal digits, two a byte, and strings are compared by their MD5.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, 1024 * k + 1, 1422) AS h FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 200) // 512 + 1)) AS k FROM d WHERE length(h) >= 400) x),
w AS (SELECT doc_id, 512 * k + i AS i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, k, h, unnest(range(0, least(length(h) // 2 - 199, 512))) AS i FROM c) x),
often AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN often USING (s)),
step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
island AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step) x GROUP BY doc_id, k),
edge AS (SELECT doc_id, a AS until, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM island
  UNION ALL SELECT d.doc_id, length(d.h) // 2, coalesce(max(i.b), 0) FROM d LEFT JOIN island i USING (doc_id) GROUP BY d.doc_id, d.h),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, CAST(2 * e.since + 1 AS BIGINT), CAST(2 * (e.until - e.since) AS BIGINT)), '' ORDER BY e.since) AS h FROM edge e JOIN d USING (doc_id) GROUP BY e.doc_id),
n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM island GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n.removed, 0) AS n_removed, coalesce(n.spans, 0) AS n_spans, lower(sha256(unhex(k.h))) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM f
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
hit AS (SELECT a.doc_id, a.i, s.n, win.item_id FROM place a, sizes s, win WHERE a.i + s.n - 1 <= len(a.w) AND win.n = s.n AND win.g = array_to_string(list_slice(a.w, a.i, a.i + s.n - 1), ' ')),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit) x) y GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, lower(sha256(coalesce(m.ids, ''))) AS items_sha256, coalesce(m.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover c USING (doc_id) LEFT JOIN item m USING (doc_id)
"""
