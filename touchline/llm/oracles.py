"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

#: Texts are compared without [\x20\x09-\x0D]; of a group the longest text stays, then the smallest id.
OP6 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:username|user|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"'<>]+"""


def _kind(number: int, name: str, pattern: str, test: str) -> str:
    """Matches of one kind with their places: the text before each match is matched lazily, lengths are added up."""
    cut = "'" + rf"(?s)(.*?)(?:({pattern})|\z)".replace("'", "''") + "'"
    value = f"regexp_extract_all(text, {cut}, 3)" if name == "assign" else f"regexp_extract_all(text, {cut}, 2)"
    return f"""
SELECT r, {number} AS kind, '{name}' AS name, stop - length(hit) AS start, stop FROM (
  SELECT r, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
    SELECT r, unnest(regexp_extract_all(text, {cut}, 1)) AS gap,
           unnest(list_transform(regexp_extract_all(text, {cut}, 2), lambda x: coalesce(x, ''))) AS hit,
           unnest({value}) AS value, unnest(range(len(regexp_extract_all(text, {cut}, 1)))) AS i
    FROM d WHERE regexp_matches(text, '{pattern.replace("'", "''")}'))) WHERE hit <> '' AND {test}"""


_PARTS = " UNION ALL ".join(_kind(i, *x) for i, x in enumerate((
    ("assign", ASSIGN, "length(value) >= 8"), ("access", ACCESS, "true"), ("hex", HEX, "true"), ("ident", IDENT, "true"),
    ("token", TOKEN, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"),
    ("endpoint", ENDPOINT, "true"))))
_NEAR = "EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.kind IN ({}) AND q.start <= p.stop + 256 AND p.start <= q.stop + 256)"
_WHO, _WHAT = _NEAR.format("1, 3"), _NEAR.format("0, 2, 4")

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_PARTS}),
s AS (SELECT * FROM p WHERE kind <= 2 OR (kind = 3 AND {_WHAT}) OR (kind = 4 AND {_WHO}) OR (kind = 5 AND {_WHO} AND {_WHAT})),
a AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind <= 2) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

OP2 = """
WITH e AS (
  SELECT row_number() OVER () AS num, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.num, q.vec_id AS query_id, e.vec_id,
         list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.num <> e.num)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES = {"op2_exact_topk": OP2, "op3_secret_scan": OP3, "op6_exact_dedup": OP6}
