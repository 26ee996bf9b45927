"""DuckDB SQL for the queries of this package that SQL can express."""

from docloom.llm.spotsigs import COMMON_WORDS

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM per_source
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap
    ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM leveled
), rated AS (
  SELECT doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), long_ones AS (
  SELECT source, size, u, ('0x' || substr(md5(coalesce('s' || source, 'n') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    + row_number() OVER (PARTITION BY source ORDER BY size DESC, u) * (rate - floor(rate)) AS spot
  FROM (SELECT DISTINCT source, size, u, rate FROM rated WHERE size * 10000 > source_size)
), draws AS (
  SELECT source, size, u, spot - floor(spot) AS draw FROM long_ones
)
SELECT doc_id, r.size, source_size, target, ((floor(rate) + (coalesce(draw, r.u) < rate - floor(rate))::INT) * r.size)::BIGINT AS taken
FROM rated r LEFT JOIN draws d ON r.source IS NOT DISTINCT FROM d.source AND r.size = d.size AND r.u = d.u
"""

OP9 = """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id::BIGINT AS id, [floor(1024.0::DOUBLE * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row AS query, q.id AS query_id, c.row AS row, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON c.row <> q.row WHERE q.id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, row)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

_COMMON = ", ".join(f"'{w}'" for w in sorted({w for line in COMMON_WORDS for w in line.split()}))
OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS n FROM documents
), e AS (
  SELECT a.n, a.doc_id, a.text, b.n AS next_n, left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) AS edited
  FROM d a JOIN d b ON b.n = a.n % (SELECT count(*) FROM d) + 1
), v AS (
  SELECT n, 0 AS kind, text AS t FROM e UNION ALL SELECT n, 1, edited FROM e
), w AS (
  SELECT n, kind, [x for x in regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+') if x <> ''] AS ws FROM v
), u AS (
  SELECT n, kind, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), c AS (
  SELECT *, word IN ({_COMMON}) AS common FROM u
), a AS (
  SELECT *, coalesce(lag(common) OVER (PARTITION BY n, kind ORDER BY i), false) AS led FROM c
), s AS (
  SELECT *, lead(word) OVER p AS second, lead(i, 7) OVER p AS eighth FROM a WHERE NOT common WINDOW p AS (PARTITION BY n, kind ORDER BY i)
), spots AS (
  SELECT n, kind, list(word || ' ' || second || ' ') AS chains FROM s WHERE second IS NOT NULL AND (led OR eighth = i + 7) GROUP BY n, kind
), every AS (
  SELECT w.n, w.kind, coalesce(chains, CASE WHEN len(ws) >= 2 THEN [ws[j] || ' ' || ws[j + 1] || ' ' for j in range(1, len(ws))] ELSE [array_to_string(ws, ' ')] END) AS chains
  FROM w LEFT JOIN spots ON spots.n = w.n AND spots.kind = w.kind
), f AS (
  SELECT n, kind, list_sort(list_distinct([substr(md5(x), 1, 8) for x in chains])) AS f FROM every
)
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(o.f, ',') AS fingerprint, array_to_string(x.f, ',') AS edited_fingerprint,
  len(list_intersect(o.f, x.f))::DOUBLE / (len(o.f) + len(x.f) - len(list_intersect(o.f, x.f))) AS near_edited,
  len(list_intersect(o.f, y.f))::DOUBLE / (len(o.f) + len(y.f) - len(list_intersect(o.f, y.f))) AS near_next
FROM e JOIN f o ON o.n = e.n AND o.kind = 0 JOIN f x ON x.n = e.n AND x.kind = 1 JOIN f y ON y.n = e.next_n AND y.kind = 0
"""

ORACLES: dict[str, str] = {"op10_spot_signatures": OP10, "op6_mixing": OP6, "op9_vector_search": OP9}
