"""SQL twins of the manifest, the clustering and the personal data query."""

from __future__ import annotations

TWINS: dict[str, str] = {}


def _lloyd(rounds: int) -> str:
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [r"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
             "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM v ORDER BY 1 LIMIT 16)"]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS (SELECT r, arg_min(c, row(d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {dist} AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            parts.append(f"""m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM
  (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{t} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c)""")
            parts.append(f"c{t + 1} AS (SELECT c, coalesce(m.x, o.x) AS x FROM c{t} o LEFT JOIN m{t} m USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} f USING (c)"""


TWINS["op12_centroid_clustering"] = _lloyd(3)


def _field(e: str) -> str:
    return f"coalesce(CAST(strlen(CAST({e} AS VARCHAR)) AS VARCHAR) || ':' || CAST({e} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(e) for e in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 (reflected polynomial 0xEDB88320) of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295)"""

TWINS["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
lower_sides AS (
  SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM tree a JOIN tree b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
upper_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
fold AS (
  SELECT source, i AS leaf_i, 0 AS level, i, now AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.source, f.leaf_i, f.level + 1, f.i // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM fold f JOIN lower_sides s ON f.source IS NOT DISTINCT FROM s.source AND f.level = s.level AND f.i = s.i),
at_subroot AS (SELECT source, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM fold GROUP BY source, leaf_i),
fold_up AS (
  SELECT a.source, a.leaf_i, 0 AS level, s.i, a.h, a.proof FROM at_subroot a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT f.source, f.leaf_i, f.level + 1, f.i // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM fold_up f JOIN upper_sides s ON f.level = s.level AND f.i = s.i),
folded AS (SELECT source, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM fold_up GROUP BY source, leaf_i)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN folded f ON l.source IS NOT DISTINCT FROM f.source AND l.i = f.leaf_i JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, top t WHERE t.n = 1"""
