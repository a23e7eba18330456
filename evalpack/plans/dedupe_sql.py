"""DuckDB oracle SQL for the near-duplicate keys: brute-force all pairs and a
row-by-row keep-first walk (recursive CTE)."""

from __future__ import annotations

from .dedupe import COSINE_T, JACCARD_T

JACCARD = f"""t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM documents),
g AS (SELECT doc_id, tok, min(doc_id) OVER (PARTITION BY tok) AS rep FROM t),
reps AS (SELECT doc_id, tok, len(tok) AS n FROM g WHERE doc_id = rep),
cmp AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.tok, b.tok)) AS inter, a.n AS na, b.n AS nb
        FROM reps a JOIN reps b ON a.doc_id < b.doc_id AND b.n >= {JACCARD_T} * a.n - 1e-9 AND a.n >= {JACCARD_T} * b.n - 1e-9),
pairs AS (SELECT a, b, inter / (na + nb - inter) AS sim FROM cmp WHERE inter / (na + nb - inter) >= {JACCARD_T}
          UNION ALL SELECT rep, doc_id, 1.0 FROM g WHERE doc_id <> rep),
copies AS (SELECT doc_id AS id FROM g WHERE doc_id <> rep),
alln AS (SELECT doc_id AS id FROM documents)"""

COSINE = f"""u AS (SELECT vec_id, CASE WHEN sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 0
        THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) END AS u
      FROM embeddings),
g AS (SELECT vec_id, u, min(vec_id) OVER (PARTITION BY u) AS rep FROM u WHERE u IS NOT NULL),
reps AS (SELECT vec_id, u FROM g WHERE vec_id = rep),
pairs AS (SELECT a, b, sim FROM (SELECT a.vec_id AS a, b.vec_id AS b,
            list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS sim
          FROM reps a JOIN reps b ON a.vec_id < b.vec_id AND len(a.u) = len(b.u)) q WHERE sim >= {COSINE_T} - 1e-12
          UNION ALL SELECT rep, vec_id, 1.0 FROM g WHERE vec_id <> rep),
copies AS (SELECT vec_id AS id FROM g WHERE vec_id <> rep),
alln AS (SELECT vec_id AS id FROM embeddings)"""

WALK = """edges AS (SELECT DISTINCT a, b FROM pairs WHERE b NOT IN (SELECT id FROM copies)),
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges) x),
preds AS (SELECT b AS id, list(a) AS pl FROM edges GROUP BY b),
walk(rn, kept) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_intersect(coalesce(p.pl, []::BIGINT[]), w.kept)) > 0 THEN w.kept
                        ELSE list_append(w.kept, n.id) END
  FROM walk w JOIN nodes n ON n.rn = w.rn + 1 LEFT JOIN preds p ON p.id = n.id),
final AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)"""

KEPT = """SELECT alln.id AS {col}, CASE WHEN alln.id IN (SELECT id FROM copies) THEN false
  WHEN alln.id IN (SELECT id FROM nodes) THEN list_contains((SELECT kept FROM final), alln.id) ELSE true END AS kept
FROM alln"""


def queries() -> dict[str, str]:
    return {
        "jaccard_pairs": f"WITH {JACCARD}\nSELECT a AS doc_a, b AS doc_b, sim AS jaccard FROM pairs",
        "dedupe_jaccard": f"WITH RECURSIVE {JACCARD},\n{WALK}\n" + KEPT.format(col="doc_id"),
        "dedupe_counters": f"WITH RECURSIVE {JACCARD},\n{WALK},\nk AS (" + KEPT.format(col="doc_id") + ")\n"
                           "SELECT count(*) AS before, count(*) FILTER (WHERE kept) AS after, "
                           "count(*) - count(*) FILTER (WHERE kept) AS removed FROM k",
        "cosine_pairs": f"WITH {COSINE}\nSELECT a AS vec_a, b AS vec_b, sim AS cosine FROM pairs",
        "dedupe_cosine": f"WITH RECURSIVE {COSINE},\n{WALK}\n" + KEPT.format(col="vec_id"),
    }
