"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
   OR 2 * length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) > word_chars OR 2 * length(regexp_replace(t, '[^\pL]+', '', 'g')) < word_chars
   OR n_lines >= 4 AND 2 * n_dup_lines > n_lines) AS kept FROM v
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * met >= 80 * (p.n + q.n - met)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, n.doc_id = min(b) AS kept FROM n JOIN reach ON a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
k AS (SELECT hex, payload_bytes, max(page_id) AS keeper FROM h GROUP BY ALL)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM h JOIN k USING (hex, payload_bytes)
"""

OP12 = r"""
WITH RECURSIVE bytes AS (SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bytes WHERE k < 8),
step AS (SELECT i, c FROM bytes WHERE k = 8),
lowered AS (SELECT 'd' AS src, doc_id AS id, row_number() OVER () AS place, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', NULL, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT src, id, place, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lowered),
kinds AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
sums AS (SELECT word, h, 0 AS pos, CAST(4294967295 AS BIGINT) AS state FROM kinds
  UNION ALL SELECT word, h, pos + 1, xor(s.c, state >> 8) FROM sums JOIN step s ON s.i = xor(state & 255, CAST('0x' || substr(h, CAST(2 * pos + 1 AS BIGINT), 2) AS BIGINT)) WHERE 2 * pos < length(h)),
code AS (SELECT word, xor(state, 4294967295) % 10000 AS bucket FROM sums WHERE 2 * pos = length(h)),
held AS (SELECT src, id, place, bucket FROM w JOIN code USING (word)),
n AS (SELECT bucket, count(*) FILTER (src = 'd') AS s, count(*) FILTER (src = 'b') AS t FROM held GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (CAST(sum(s) OVER () AS DOUBLE) + 10000.0) / (CAST(s + 1 AS DOUBLE) * (CAST(sum(t) OVER () AS DOUBLE) + 10000.0)))) AS BIGINT) AS g FROM n),
weights AS (SELECT place, count(*) AS n, CAST(sum(g) AS BIGINT) AS w FROM held JOIN gain USING (bucket) WHERE src = 'd' GROUP BY place),
d AS (SELECT id AS doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM lowered LEFT JOIN weights USING (place) WHERE src = 'd'),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM ranked
"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
each AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
runs AS (SELECT lang, CAST(k AS BIGINT) AS k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM each CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
sides AS (SELECT c.*, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f + r.f) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, cut), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, cut + 1, c.k), ' ')),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (SELECT lang, a AS above, array_to_string(list_slice(ws, s, s + m - 1), ' ') AS phrase FROM c CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < k AND s + m - 1 <= k),
held AS (SELECT lang, phrase, max(above) AS above FROM inner_runs GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase JOIN total t ON t.lang = b.lang WHERE above IS NULL OR 100::HUGEINT * above < 80 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
"""
