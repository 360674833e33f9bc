"""DuckDB SQL that gives the rows of queries by joining everything with everything; for small tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _components(nodes: str, links: str) -> str:
    """CTEs from links (x, y): both ways, and every node with all that it reaches."""
    return f"""
both_ways AS (SELECT x, y FROM {links} UNION ALL SELECT y, x FROM {links}),
reach AS (SELECT id, id AS other FROM {nodes} UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id AS id, {_words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents),
shingle AS (
  SELECT DISTINCT id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
pair AS (
  SELECT a.id AS x, b.id AS y, count(*) AS common
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.id = x JOIN size q ON q.id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
{_components("words", "link")}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM component LEFT JOIN size USING (id)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH doc AS (SELECT doc_id, {_words("text", _ALNUM)} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark),
part AS (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM part),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, item, k, i FROM place JOIN win USING (k) WHERE array_to_string(w[i:i + k - 1], ' ') = t),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

WARC = """
WITH payload AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM payload)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM last"""

VECTOR_JOIN = f"""
WITH RECURSIVE vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
most AS (SELECT id, v, list_max(list_transform(v, lambda c: abs(c))) AS m FROM vec WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
usable AS (SELECT id, list_transform(v, lambda c: c / pow(2, floor(log2(m)))) AS v FROM most WHERE m > 0),
link AS (
  SELECT a.id AS x, b.id AS y FROM usable a JOIN usable b ON a.id < b.id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.9 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
{_components("vec", "link")},
degree AS (SELECT x AS id, count(*) AS n FROM both_ways GROUP BY x)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM component LEFT JOIN degree USING (id)"""

_SAID = "left(sha256(length(role) || ':' || role || text), 32)"

PREFIX_TRIE = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, {_SAID}) AS pos FROM said),
conv AS (
  SELECT c, c - c % 20 AS base, n,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c), crc_table),
placed AS (
  SELECT conv.c, pos AS d, role, text FROM conv JOIN own ON own.c = base AND pos <= h
  UNION ALL SELECT conv.c, pos - conv.h + least(conv.h, coalesce(b.n, 0)), role, text FROM conv JOIN own ON own.c = conv.c AND pos > conv.h LEFT JOIN conv b ON b.c = conv.base),
seq AS (SELECT conv.c, list(struct_pack(role, text) ORDER BY d) FILTER (d IS NOT NULL) AS s FROM conv LEFT JOIN placed USING (c) GROUP BY conv.c),
member AS (SELECT c, d, coalesce(s, [])[1:d] AS p, coalesce(len(s), 0) = d AS is_end FROM (SELECT c, s, unnest(range(0, coalesce(len(s), 0) + 1)) AS d FROM seq)),
node AS (
  SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
  FROM member GROUP BY p),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
worth AS (
  SELECT node.p, d, child.n IS NULL AS leaf, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node.p[d].text, '[^ 	-
]+')) END AS saved
  FROM node LEFT JOIN child ON child.p = node.p),
total AS (SELECT p[1:k] AS p, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM worth) GROUP BY 1)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN total ON total.p = node.p LEFT JOIN child ON child.p = node.p LEFT JOIN node up ON node.d > 0 AND up.p = node.p[1:node.d - 1]"""
