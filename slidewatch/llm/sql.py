"""The same results as plain SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

import string

#: Words between ASCII blanks, and runs of letters and digits with A-Z lowered.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _letters(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"regexp_extract_all({lowered}, '{LETTER_WORD}')"


SUBSTRING_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS words FROM documents
), w AS (
  SELECT doc_id, k, array_to_string(words[k:k + 19], ' ') AS line
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM d)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM later
), stays AS (
  SELECT p.doc_id, p.k, p.word FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d) p
  ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k
), lines AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS line FROM stays GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(l.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(l.line, '')) AS kept_sha256
FROM d LEFT JOIN lines l ON d.doc_id = l.doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS words FROM documents
), w AS (
  SELECT doc_id, k, words[k] AS a, words[k + 1] AS b, words[k + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM d)
), twice AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM twice) GROUP BY doc_id
), counts AS (
  SELECT doc_id, max(n) AS top FROM (
    SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word
  ) GROUP BY doc_id
), r AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(counts.top, 0) AS top,
    len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS shouted,
    len(list_filter(words, lambda x: NOT regexp_matches(x, '\pL'))) AS unlettered
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN counts USING (doc_id)
), s AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 10 * shouted > 3 * n_words OR 2 * n_dup_lines > n_lines
    OR top::DOUBLE / n_words > 0.3 OR NOT (word_chars BETWEEN 2 * n_words AND 25 * n_words) OR 10 * unlettered > 4 * n_words) AS kept
FROM s
"""

DECONTAMINATION = rf"""
WITH b AS (
  SELECT item_id, {_letters("text")} AS words FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[k:k + 9], ' ') AS line
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS k FROM b WHERE len(words) > 0)
), d AS (
  SELECT doc_id, {_letters("text")} AS words FROM documents
), windows AS (
  SELECT doc_id, k, n, array_to_string(words[k:k + n - 1], ' ') AS line FROM (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM phrases)
  )
), found AS (
  SELECT w.doc_id, w.k, w.n, p.item_id FROM windows w JOIN phrases p ON w.n = p.n AND w.line = p.line
), hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""



#: The 256 values a byte can turn the checksum by, from the rule above, one bit after the other.
_CRC_TABLE = """
  SELECT b, value FROM (
    WITH RECURSIVE t AS (
      SELECT b::BIGINT AS b, b::BIGINT AS value, 0 AS k FROM range(256) r(b)
      UNION ALL
      SELECT b, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, k + 1 FROM t WHERE k < 8
    ) SELECT b, value FROM t WHERE k = 8
  )
"""


def _runs(table: str) -> str:
    return f"""
  SELECT id, n_words, run FROM (
    SELECT id, len(words) AS n_words, unnest(list_concat(
      words,
      list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]),
      list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])
    )) AS run FROM {table}
  )"""


RESAMPLING = rf"""
WITH crc_table AS MATERIALIZED ({_CRC_TABLE}),
turns AS MATERIALIZED (SELECT list(value ORDER BY b) AS t FROM crc_table),
d AS MATERIALIZED (SELECT doc_id AS id, {_letters("text")} AS words FROM documents),
b AS MATERIALIZED (SELECT NULL::BIGINT AS id, {_letters("text")} AS words FROM benchmark),
dr AS MATERIALIZED ({_runs("d")}),
br AS MATERIALIZED ({_runs("b")}),
distinct_runs AS MATERIALIZED (SELECT DISTINCT run FROM (SELECT run FROM dr UNION ALL SELECT run FROM br)),
bytes AS (
  SELECT run, list_transform(range(octet_length(encode(run))), lambda k: ('0x' || substr(hex(encode(run)), 2 * k + 1, 2))::BIGINT) AS b
  FROM distinct_runs
),
hashed AS MATERIALIZED (
  SELECT run, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM bytes, turns
),
s AS (SELECT bucket, count(*) AS n FROM dr JOIN hashed USING (run) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM br JOIN hashed USING (run) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dr)::DOUBLE AS s, (SELECT count(*) FROM br)::DOUBLE AS t),
gain AS MATERIALIZED (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (totals.s + 10000) / ((s.n::DOUBLE + 1) * (totals.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
),
weighed AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dr JOIN hashed USING (run) JOIN gain USING (bucket) GROUP BY id
),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT id AS doc_id, words FROM d) LEFT JOIN weighed ON doc_id = id
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

SQL = {
    "op12_resampling": RESAMPLING, "op13_hard_negatives": HARD_NEGATIVES,
    "op3_substring_dedup": SUBSTRING_DEDUP, "op4_quality_rules": QUALITY_RULES, "op6_decontamination": DECONTAMINATION,
}
