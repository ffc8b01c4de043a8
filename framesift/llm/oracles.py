"""DuckDB SQL for the operators that SQL can express and run over whole tables."""

from __future__ import annotations

from framesift.llm import licenses

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, len(list_filter(w, lambda x: regexp_matches(x, '(?s)[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_capital_words
  FROM lined LEFT JOIN repeated USING (rid)),
judged AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 10 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_letter_words < 8 * n_words THEN 32 ELSE 0 END + CASE WHEN 10 * n_capital_words > 3 * n_words THEN 64 ELSE 0 END AS fail_bits FROM measured)
"""

LEDGER = f"""{QUALITY}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_letter_words AS BIGINT) AS n_letter_words, CAST(n_capital_words AS BIGINT) AS n_capital_words, fail_bits % 4 > 0 AS base_failed, fail_bits = 0 AS kept,
  CAST(fail_bits AS BIGINT) AS fail_bits, fail_bits & 3 = 0 AS kept_v1, fail_bits & 15 = 0 AS kept_v2, fail_bits = 0 AS kept_v3 FROM judged"""

ABLATION = f"""{QUALITY},
rules(rule, bit) AS (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16), ('letters', 32), ('capitals', 64)), policies(version, mask) AS (VALUES (1, 3), (2, 15), (3, 127)),
masked AS (SELECT version, mask, CAST(fail_bits AS INTEGER) & mask AS bits, count(*) AS n FROM judged, policies GROUP BY version, mask, bits)
SELECT version, rule, CAST(coalesce(sum(n) FILTER (bits & bit > 0), 0) AS BIGINT) AS n_failed, CAST(coalesce(sum(n) FILTER (bits = bit), 0) AS BIGINT) AS n_failed_alone,
  CAST(coalesce(sum(n) FILTER (bits = bit OR bits = 0), 0) AS BIGINT) AS n_kept_without FROM masked JOIN rules ON mask & bit > 0 GROUP BY version, rule"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM later, range(20) r(k)),
kept AS (SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.p) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) d ANTI JOIN gone g ON g.doc_id = d.doc_id AND g.p = d.p GROUP BY d.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

_CRC = """poly(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8)"""


def _crc(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, by the table ``crc``."""
    numbers = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {numbers}), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


_LOWERED = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLED = f"""
WITH RECURSIVE {_CRC},
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED} AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word FROM docs), target AS (SELECT unnest({_LOWERED}) AS word FROM benchmark),
known AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM words UNION SELECT word FROM target), crc),
s AS (SELECT bucket, count(*) AS n FROM words JOIN known USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM target JOIN known USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM words) + 10000) / ((coalesce(s.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT count(*) FROM target) + 10000)))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM known) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT rid, sum(g) AS weight FROM words JOIN known USING (word) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (rid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= 20) AS eligible FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank FROM ranked"""


def _cells(column: str, name: str) -> str:
    return f"""{name} AS (SELECT {column}, coalesce(sum(n) OVER (ORDER BY {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 // sum(n) OVER () AS c_{name}
  FROM (SELECT {column}, count(*) AS n FROM docs WHERE {column} IS NOT NULL GROUP BY {column}))"""


_PLACE = " + ".join(f"((xor({v}, flip) >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(4) for i, v in enumerate(("x", "xor(x, y)", "xor(xor(x, y), z)")))

SHARDS = f"""
WITH RECURSIVE {_CRC},
docs AS (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
{_cells("source", "sources")}, {_cells("lang", "langs")}, {_cells("size", "sizes")},
celled AS (SELECT docs.*, CAST(coalesce(c_sources, 0) AS BIGINT) AS a, CAST(coalesce(c_langs, 0) AS BIGINT) AS b, CAST(coalesce(c_sizes, 0) AS BIGINT) AS c
  FROM docs LEFT JOIN sources USING (source) LEFT JOIN langs USING (lang) LEFT JOIN sizes USING (size)),
turned(a, b, c, x, y, z, k) AS (
  SELECT DISTINCT a, b, c, a, b, c, 0 FROM celled
  UNION ALL
  SELECT a, b, c, CASE WHEN own & bit > 0 THEN xor(x, bit - 1) ELSE xor(x, xor(x, own) & (bit - 1)) END,
    CASE WHEN axis = 1 AND own & bit = 0 THEN xor(y, xor(x, own) & (bit - 1)) ELSE y END, CASE WHEN axis = 2 AND own & bit = 0 THEN xor(z, xor(x, own) & (bit - 1)) ELSE z END, k + 1
  FROM (SELECT *, k % 3 AS axis, CAST(8 AS BIGINT) >> (k // 3) AS bit, CASE k % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS own FROM turned WHERE k < 9)),
coded AS (SELECT a, b, c, x, y, z, xor(xor(CASE WHEN last & 2 > 0 THEN 1 ELSE 0 END, CASE WHEN last & 4 > 0 THEN 3 ELSE 0 END), CASE WHEN last & 8 > 0 THEN 7 ELSE 0 END) AS flip
  FROM (SELECT *, xor(xor(x, y), z) AS last FROM turned WHERE k = 9)),
curve AS (SELECT a, b, c, {_PLACE} AS h FROM coded),
placed AS (SELECT *, row_number() OVER (ORDER BY h, text_crc32, size, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM celled JOIN curve USING (a, b, c)),
dealt AS (SELECT *, place * 24 // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

ORACLES = {
    "op2_quality_rules": LEDGER, "quality_ablation": ABLATION, "op8_substring_dedup": SUBSTRINGS, "op9_license_scan": licenses.oracle(),
    "op11_importance": RESAMPLED, "op13_sharding": SHARDS,
}
