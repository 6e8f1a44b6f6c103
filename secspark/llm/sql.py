"""DuckDB SQL of the longer queries."""

LINES = r"""
WITH text AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s[^>]*)?/?>', chr(10), 'g'),
      '<[!/?a-zA-Z][^>]*>', '', 'g') AS t
  FROM pages
), pl AS (
  SELECT page_id, host, list_filter(list_transform(string_split(
    replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), chr(10)),
    lambda x: regexp_replace(x, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g')), lambda x: x <> '') AS ls
  FROM text
), counts AS (
  SELECT host, l, count(*) AS n FROM (SELECT host, unnest(list_distinct(ls)) AS l FROM pl) GROUP BY ALL
), bad AS (
  SELECT host, list(l) AS b FROM counts JOIN (SELECT host, count(*) AS p FROM pl GROUP BY host) USING (host)
  WHERE n >= 2 AND n > 0.3 * p GROUP BY host
), kept AS (
  SELECT page_id, host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(b, []), x)) AS ks FROM pl LEFT JOIN bad USING (host)
)
SELECT page_id, host, len(ls) AS n_lines, len(ls) - len(ks) AS n_dropped, sha256(coalesce(array_to_string(ks, chr(10)), '')) AS kept_sha256 FROM kept
"""

MIXING = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS b FROM docs GROUP BY source
), rates AS (
  SELECT source, (CAST(sum(size) AS BIGINT) - 1) // 16384 + 1 AS blocks,
    CAST(CASE WHEN regexp_matches(source, '^src([0-9]|1[0-9])$') THEN 1 + CAST(substr(source, 4) AS BIGINT) % 4 ELSE 1 END AS BIGINT) AS rate
  FROM docs GROUP BY source
), plan AS (
  SELECT list(source ORDER BY source) AS s, list(rate ORDER BY source) AS q, CAST(sum(rate) AS BIGINT) AS p, max((blocks * (SELECT sum(rate) FROM rates) + rate - 1) // rate) AS stop FROM rates
), edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS j, p, q, stop FROM plan
  UNION ALL
  SELECT t + 1, list_transform(had, lambda n, i: CASE WHEN i = pos THEN n + 1 ELSE n END), pos, had[pos], p, q, stop
  FROM (
    SELECT *, CAST(list_position(dues, list_min(dues)) AS BIGINT) AS pos FROM (
      SELECT *, list_transform(had, lambda k, i: CASE WHEN k * p // q[i] <= t + 1 THEN ((k + 1) * p + q[i] - 1) // q[i] ELSE 4611686018427387903 END) AS dues
      FROM edf WHERE t + 1 < stop
    )
  )
), slots AS (
  SELECT plan.s[pick] AS source, j AS block, j * plan.p // plan.q[pick] AS release, ((j + 1) * plan.p + plan.q[pick] - 1) // plan.q[pick] AS deadline, t AS slot
  FROM edf, plan WHERE t >= 0
), placed AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM docs
), pieces AS (
  SELECT *, unnest(range(before // 16384, (before + size - 1) // 16384 + 1)) AS block FROM placed
)
SELECT doc_id, source, size, block, greatest(0, block * 16384 - before) AS start,
  least(size, (block + 1) * 16384 - before) - greatest(0, block * 16384 - before) AS bytes,
  release, deadline, slot, row_number() OVER (ORDER BY slot, before, doc_id, size) - 1 AS position
FROM pieces JOIN slots USING (source, block)
"""

SHARDS = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(n)
  )
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), sums AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(1, CAST(strlen(text) AS BIGINT) + 1), lambda i: CAST(instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 17 AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS text_crc32
  FROM (SELECT text, hex(encode(text)) AS h FROM texts), crc
), docs AS (
  SELECT doc_id, CAST(strlen(coalesce(d.text, '')) AS BIGINT) + 1 AS size, text_crc32 FROM documents d JOIN sums s ON coalesce(d.text, '') = s.text
), slotted AS (
  SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS INT) AS vslot FROM docs
), totals AS (
  SELECT CAST(v AS INT) AS vslot, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM range(4096) r(v) LEFT JOIN (SELECT vslot, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM slotted GROUP BY vslot) ON vslot = v
), items AS (
  SELECT list({'b': b, 'v': vslot} ORDER BY b DESC, vslot) AS x FROM totals
), dealt AS (
  SELECT 0 AS k, CAST(NULL AS INT) AS vslot, CAST(NULL AS BIGINT) AS shard, list_transform(range(16), lambda i: CAST(0 AS BIGINT)) AS load
  UNION ALL
  SELECT k + 1, x[k + 1].v, pos, list_transform(load, lambda l, i: CASE WHEN i = pos + 1 THEN l + x[k + 1].b ELSE l END)
  FROM (SELECT *, CAST(list_position(load, list_min(load)) - 1 AS BIGINT) AS pos FROM dealt), items WHERE k < 4096
), map AS (
  SELECT t.vslot, CAST(shard AS INT) AS shard, CAST(coalesce(sum(n) OVER (PARTITION BY shard ORDER BY t.vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
  FROM totals t JOIN dealt d ON d.vslot = t.vslot
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, base + row_number() OVER (PARTITION BY vslot ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard, vslot
FROM slotted JOIN map USING (vslot)
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents
), ws AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang
), starts AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM ws, (VALUES (1), (2), (3), (4)) t (k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase FROM starts) GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, f FROM counts WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, f, c, array_to_string(list_slice(string_split(phrase, ' '), 1, c), ' ') AS head, array_to_string(list_slice(string_split(phrase, ' '), c + 1, k), ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) t (c) WHERE c < k
), scored AS (
  SELECT x.lang, x.k, x.phrase, x.f AS a, x.c, a.f AS l, b.f AS r, (2000000::HUGEINT * x.f // (a.f + b.f))::BIGINT AS score
  FROM cuts x JOIN counts a ON a.lang = x.lang AND a.phrase = x.head JOIN counts b ON b.lang = x.lang AND b.phrase = x.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), stay AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM candidates y
    WHERE y.lang = x.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100::HUGEINT * y.f >= 80 * x.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM stay JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

_VECTORS = """
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

TOP_PRODUCTS = f"""
WITH v AS ({_VECTORS}), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_VECTORS}) WHERE label IS NOT NULL
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
