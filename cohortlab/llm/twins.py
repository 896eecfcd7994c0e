"""DuckDB twins that are built from a rule."""

from __future__ import annotations


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Product codes by definition: every part against every entry, one pair of CTEs a round."""
    far = "list_sum([(a.x[i] - b.c[i]) * (a.x[i] - b.c[i]) FOR i IN range(1, len(a.x) + 1)])"
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), a AS (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS u(p)
), b0 AS (SELECT p, r - 1 AS e, x AS c FROM a WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"n{k} AS (SELECT a.r, a.p, a.x, min({{'d': {far}, 'e': b.e}}) AS best FROM a JOIN b{k} AS b USING (p) GROUP BY a.r, a.p, a.x)")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM n{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
    ) GROUP BY p, e
  ) AS m USING (p, e)
)""")
    return ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY r
), book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), book
"""
