"""The text operators that SQL can express, for DuckDB."""

from __future__ import annotations

SUBSTRINGS = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) AS p FROM d)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 13)))) AS g FROM win JOIN first USING (s) WHERE doc_id > least GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, len(coalesce(g, [])) AS n_removed, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) AS kept_sha256 FROM kept
"""


def lloyd(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Every distance of every round; the exact floor is that of the remainder taken off first."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v.x, c.c, c.x AS y, CAST({apart} AS BIGINT) AS d FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c.c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, CAST(sum(z) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS z, unnest(range(1, {dim + 1})) AS j FROM a{i}) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY c) m USING (c))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(y, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds}"


INFILL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
