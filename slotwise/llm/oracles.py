"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force.

The windows of op6 are taken by plain string equality, op11's checksums of distinct words only, op13's orders by joins. op8's walk is a recursive query in 128-bit integers, and its
checksum a fold over the bytes of the text; up to four million rows a shard's slots follow id, size and checksum.
"""

from __future__ import annotations

FOLD = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS line
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n
), hits AS (
  SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS line FROM places)
  JOIN windows USING (n, line)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

OP8 = """
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), bits AS (
  SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), codes AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), summed AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2),
      lambda p: ((strpos('0123456789ABCDEF', h[p + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[p + 2]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM rows, codes
), walk AS (
  SELECT DISTINCT doc_id, -1::BIGINT AS b, 0::BIGINT AS j,
    CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS key
  FROM documents
  UNION ALL
  SELECT doc_id, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT, next
  FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM walk WHERE j < 41)
), homes AS (
  SELECT doc_id, max(b) FILTER (WHERE b < 40)::INTEGER AS shard, max(b)::INTEGER AS grown_shard FROM walk GROUP BY doc_id
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, s.size, s.text_crc32) - 1 AS slot, grown_shard
FROM summed s JOIN homes h ON s.doc_id IS NOT DISTINCT FROM h.doc_id
"""

CRC_CODES = """
bits AS (
  SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), codes AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
)"""
DIGIT = "(strpos('0123456789ABCDEF', {h}[{i}]) - 1)::BIGINT"
FIRST_EIGHT = " + ".join(f"{DIGIT.format(h='h', i=i + 1)} * {16 ** (7 - i)}" for i in range(8))

OP11 = f"""
WITH RECURSIVE {CRC_CODES}, texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, {WORDS.format(text="text")} AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, {WORDS.format(text="text")} FROM benchmark
), features AS (
  SELECT side, r, unnest(w) AS word FROM texts
), known AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2),
      lambda p: ((strpos('0123456789ABCDEF', h[p + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[p + 2]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM features), codes
), placed AS (
  SELECT side, r, bucket FROM features JOIN known USING (word)
), totals AS (
  SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed
), gains AS (
  SELECT bucket, floor(1000 * ln(((b.t + 1) * (totals.s + 10000))::DOUBLE / ((b.s + 1) * (totals.t + 10000))::DOUBLE))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket) b, totals
), weighed AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((({FIRST_EIGHT}) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT r, doc_id, w, upper(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))) AS h FROM texts WHERE side = 'd')
  LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

OP13 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts
), failed AS (
  SELECT part,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM words
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)
), steps AS (
  SELECT filter_order, step, filter_order[1 : step - 1] AS before, filter_order[step] AS own FROM orders, range(1, 6) s(step)
), seen AS (
  SELECT part, filter_order, step::INTEGER AS step, own,
    contains(fails, own) AS failing, length(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone,
    fails, n, good, toxic
  FROM counted, steps
), counts AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counts
"""

ORACLES: dict[str, str] = {
    "op6_benchmark_windows": OP6, "op8_jump_hash_shards": OP8, "op11_importance_resampling": OP11,
    "op13_filter_diagrams": OP13,
}
