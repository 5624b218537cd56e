"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from stationcast.llm.mixing import offset

OP2 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

OP3 = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
d AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN t IS NULL OR len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS g
  FROM w
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.a = s.doc_id
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), q AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM p
), r AS (
  SELECT *, source_size * 2 AS most, source_size * 2 / CAST(weight AS DOUBLE) AS full_at,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS all_words, CAST(sum(weight) OVER () AS BIGINT) AS all_weights FROM q
), t AS (
  SELECT *,
    all_words - CAST(coalesce(sum(most) OVER o, 0) AS DOUBLE) AS words_left,
    all_weights - CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weights_left
  FROM r WINDOW o AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(CASE WHEN words_left / weights_left <= full_at THEN words_left END) OVER () AS lw,
    max(CASE WHEN words_left / weights_left <= full_at THEN weights_left END) OVER () AS lg FROM t
), g AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(weight * lw / lg, CAST(most AS DOUBLE))) AS target FROM l
), n AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY CAST(floor(log2(size + 1.0::DOUBLE) * 4) AS INTEGER),
      substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3), size, doc_id) AS nth
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate * nth + {offset(7)!r}::DOUBLE) - floor(rate * (nth - 1) + {offset(7)!r}::DOUBLE)) AS BIGINT) AS taken
FROM n
"""


def _kind(name: str, place: int, pattern: str, group: int, least: int) -> str:
    """(doc_id, start, end, place, kind) of one rule: gaps before matches and matches, summed up."""
    quoted = f"(?s)(.*?)({pattern})".replace("'", "''")
    return f"""
  SELECT doc_id, CAST(list_sum(lens[1:i]) - len(hits[i]) AS BIGINT) AS a, CAST(list_sum(lens[1:i]) AS BIGINT) AS b, {place} AS place, '{name}' AS kind
  FROM (
    SELECT doc_id, hits, secrets, list_transform(range(1, len(hits) + 1), lambda i: len(gaps[i]) + len(hits[i])) AS lens,
      unnest(range(1, len(hits) + 1)) AS i
    FROM (
      SELECT doc_id, regexp_extract_all(text, '{quoted}', 1) AS gaps, regexp_extract_all(text, '{quoted}', 2) AS hits,
        regexp_extract_all(text, '{quoted}', {2 + group}) AS secrets
      FROM documents WHERE text IS NOT NULL
    )
  ) WHERE len(secrets[i]) >= {least}"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = [
    ("assign", 0, rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, r"[0-9a-f]{24,}", 0, 24),
    ("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("personal", 4, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]
OP9 = f"""
WITH f AS ({" UNION ALL ".join(_kind(*k) for k in KINDS)}),
g AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op2_exact_top_k": OP2,
    "op3_embedding_links": OP3,
    "op4_minhash_near_duplicates": OP4,
    "op6_source_mix": OP6,
    "op9_secret_ledger": OP9,
}
