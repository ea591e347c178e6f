"""DuckDB SQL for the queries that SQL can express."""

#: Fixed values of the mixing query: seed 17, weights 3, 1, 2, 150 % of all words, at most 2 epochs.
MIXING = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, text,
    (('0x' || substr(md5('17' || coalesce(':' || doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    0.1::DOUBLE + 0.9::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - 5::DOUBLE * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D.,;:!?''-]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS w
  FROM documents),
sources AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 2::DOUBLE END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source)),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2::DOUBLE * coalesce(sum(source_size) OVER up, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level,
    row_number() OVER up_all AS nth
  FROM sources WINDOW up_all AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, encode(source)),
    up AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (
  SELECT source, source_size, weight, CASE WHEN coalesce(2::DOUBLE * source_size <= last * weight, TRUE) THEN 2::DOUBLE * source_size ELSE last * weight END AS target
  FROM (SELECT *, arg_min(CASE WHEN 2::DOUBLE * source_size > level * weight THEN level END, nth) OVER () AS last FROM levels)),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM target),
ranked AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY exp(ln(u) / w) DESC, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM ranked
"""

EXACT = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
judged AS (
  SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM lines)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def _k_means(dim: int = 64, count: int = 8, rounds: int = 10) -> str:
    """Components as rows; each round an assignment and the floors of the means."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"comp AS MATERIALIZED (SELECT r, unnest(generate_series(0, {dim - 1})) AS d, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, d, v FROM comp JOIN (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, embedding) - 1 AS c FROM kept) USING (r) WHERE c < {count})",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, c, far FROM (SELECT x.r, y.c, sum((x.v - y.v) * (x.v - y.v))::BIGINT AS far FROM comp x JOIN c{k} y USING (d) GROUP BY x.r, y.c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)")
        if k < rounds:
            parts.append(f"m{k} AS MATERIALIZED (SELECT c, d, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN comp USING (r) GROUP BY c, d)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, d, ((s - (s % n + n) % n) // n)::BIGINT AS v FROM m{k} UNION ALL SELECT c, d, v FROM c{k} WHERE c NOT IN (SELECT c FROM m{k}))")
    return f"""WITH {", ".join(parts)},
prints AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN prints USING (c)"""


SQL = {"op13_kd_means": _k_means(), "op11_line_dedup": LINES, "op1_mixing": MIXING, "op3_exact_dedup": EXACT}
