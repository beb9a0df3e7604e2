"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from . import toolview

ORACLES = {}

ORACLES["op1_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM dwin d JOIN win i ON d.n = i.n AND d.win = i.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

ORACLES["op5_chat"] = toolview.oracle()

ORACLES["op7_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (
  SELECT page_id, n, first,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST(('0x' || substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS digest
  FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


def _license_sql() -> str:
    from .licenses import TEMPLATES

    values = ", ".join("(" + str(i) + ", '" + x + "', '" + n.replace("'", "''") + "')" for i, (x, n) in enumerate(TEMPLATES))
    return rf"""
WITH t AS (
  SELECT template, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT column0 AS template, column1 AS license, regexp_extract_all(lower(column2), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM (VALUES {values}) v(column0, column1, column2))),
parts AS (
  SELECT doc_id, part, s FROM (
    SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS part
    FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\r\n]') AS l FROM documents WHERE text IS NOT NULL))
  UNION ALL
  SELECT doc_id, -1 - part, s FROM (
    SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS part
    FROM (SELECT doc_id, regexp_split_to_array(text, '(\r\n|[\r\n])[ \t]*(\r\n|[\r\n])\s*') AS l FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(s, '[\r\n]')),
p AS (
  SELECT doc_id, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT doc_id, part, regexp_extract_all(lower(s), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM parts) WHERE len(w) >= 2),
m AS (
  SELECT doc_id, part, license, max(2 * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b))) AS dice
  FROM p JOIN t ON 5 * 2 * len(list_intersect(p.b, t.b)) >= 4 * (len(p.b) + len(t.b)) GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(dice, 0.0) AS best_dice
FROM documents d LEFT JOIN g USING (doc_id)
"""


ORACLES["op8_license"] = _license_sql()

ORACLES["op6_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i : i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM ends UNION SELECT r.x, b.y FROM reach r JOIN ends b ON r.y = b.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id,
       coalesce(l.y, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.x = d.doc_id
"""
