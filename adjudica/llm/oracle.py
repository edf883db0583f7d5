"""SQL (DuckDB) that states the results of the operators' queries, where SQL can.

Without SQL: op1, op7 (trained models), op5 (page structure), op6 (the tokenizer), op8 (the filter's probes), op10
(shingles' XXH64), op11 (every string of 400 bytes) and the pipeline; tests hold those against brute force or held-out
accuracy.  The crc32 of op4 and op12 is spelt out byte by byte, as DuckDB has no such function.
"""

from __future__ import annotations

_WHITE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP3 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(CAST(n AS DOUBLE), 0.5) / sum(pow(CAST(n AS DOUBLE), 0.5)) OVER () * sum(n) OVER () / n AS rate FROM n),
keyed AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND count(*) OVER (PARTITION BY doc_id) = 1 THEN CAST(doc_id AS VARCHAR)
    ELSE coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || CAST(row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS VARCHAR) END AS key
  FROM documents
),
draws AS (
  SELECT d.*, r.rate, CAST(('0x' || substr(md5('17:' || key || ':' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u,
         r.rate / greatest(1, ceil(r.rate / 16)) AS lam, i
  FROM keyed d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source,
  LATERAL (SELECT unnest(range(1, CAST(greatest(1, ceil(r.rate / 16)) AS BIGINT) + 1)) AS i)
),
lams AS (SELECT DISTINCT lam FROM draws),
terms(lam, k, p, cdf) AS (
  SELECT lam, CAST(0 AS BIGINT), exp(-lam), exp(-lam) FROM lams
  UNION ALL
  SELECT lam, k + 1, p * lam / (k + 1), cdf + p * lam / (k + 1) FROM terms WHERE k < 96
),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, rate, key, CAST(sum((SELECT count(*) FROM terms t WHERE t.lam = w.lam AND t.k < 96 AND t.cdf <= w.u)) AS BIGINT) AS copies
  FROM draws w GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, rate, copies, copy_no,
       CAST(('0x' || substr(md5('17:' || key || ':' || CAST(copy_no AS VARCHAR)), 14, 13)) AS BIGINT) AS mix_key
FROM counts, LATERAL (SELECT unnest(range(0, copies)) AS copy_no)
"""

OP4 = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS b))
), bytes AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), hashed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table
), walk(doc_id, key, b, j) AS (
  SELECT DISTINCT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, k, j, CAST(floor((j + 1) * (2147483648.0 / CAST((k // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, b, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM walk WHERE j <= 16)
), shards AS (
  SELECT doc_id, CAST(max(CASE WHEN b < 16 THEN b END) AS INTEGER) AS shard, CAST(max(CASE WHEN b < 17 THEN b END) AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM hashed JOIN shards USING (doc_id)
"""

OP9 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

OP12 = rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS b))
), texts AS (
  SELECT TRUE AS doc, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT FALSE, -row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT doc, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), words AS (SELECT doc, r, unnest(ws) AS w FROM split),
hexed AS (SELECT w, hex(encode(w)) AS h, strlen(w) AS n FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST((SELECT sum(s) FROM counts) + 10000 AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST((SELECT sum(t) FROM counts) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts
), sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE doc GROUP BY r
), weighed AS (
  SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight
  FROM (SELECT r, doc_id FROM split WHERE doc) LEFT JOIN sums USING (r)
), scored AS (
  SELECT r, doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM weighed
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, 10 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sized AS (SELECT lang, ws, k FROM words, (SELECT unnest(range(1, 5)) AS k)),
grams AS (SELECT lang, k, ws, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM sized),
f AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f FROM f WHERE k >= 2 AND f >= 30),
cut AS (SELECT lang, k, g, f, unnest(range(1, k)) AS j FROM c),
scored AS (
  SELECT cut.lang, cut.g, cut.k, cut.f AS a, j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * cut.f) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = list_slice(cut.g, 1, j) JOIN f y ON y.lang = cut.lang AND y.g = list_slice(cut.g, j + 1, cut.k)
), least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS rn FROM scored) WHERE rn = 1),
inner_sizes AS (SELECT lang, g, k, f, unnest(range(2, k)) AS m FROM c WHERE k > 2),
inner_at AS (SELECT lang, g, k, f, m, unnest(range(1, k - m + 2)) AS i FROM inner_sizes),
most AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS most FROM inner_at GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN most USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op2_exact_topk": OP2, "op3_mix_sources": OP3, "op4_jump_shards": OP4, "op9_exact_dedup": OP9, "op12_importance_resampling": OP12, "op13_collocations": OP13}
