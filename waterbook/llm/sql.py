"""DuckDB SQL of the queries that SQL can express, written from what each
query returns and not from how the operator finds it."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# five hex digits are four letters
_LETTERS = "string_agg(" + " || ".join(f"substr('{_BASE32}', 1 + ((n >> {s}) & 31)::INT, 1)" for s in (15, 10, 5, 0)) + ", '' ORDER BY k)"

WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
tops AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM payloads),
digests AS (
  SELECT hex, {_LETTERS} AS digest
  FROM (SELECT hex, k, ('0x' || substr(hex, 1 + 5 * k::INT, 5))::BIGINT AS n FROM (SELECT DISTINCT hex FROM payloads), range(8) r(k))
  GROUP BY hex)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM tops JOIN digests USING (hex)
"""

JACCARD = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
members AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.node)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, r.component_id
FROM sets d JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def _assigned(books: str) -> str:
    """Nearest entry and squared distance of every part: the least of 64 * distance + index."""
    return f"""SELECT row, p, x, least % 64 AS e, least // 64 AS error FROM (
  SELECT row, parts.p AS p, any_value(parts.x) AS x, min(64 * list_sum(list_transform(list_zip(parts.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + c.e)::BIGINT AS least
  FROM parts JOIN {books} c ON c.p = parts.p GROUP BY row, parts.p)"""


def _refined(books: str, assigned: str) -> str:
    return f"""SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN (
  SELECT p, e, list(v ORDER BY i) AS x FROM (
    SELECT p, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM {assigned}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY p, e, i)
  GROUP BY p, e) m ON m.p = c.p AND m.e = c.e"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_refined("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_refined("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b2)) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""
