"""Quality rules over the documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import ENOUGH, FENCE, MEASURES, TAILS, judge
from .registry import query, table

_BASE = r"""
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
split AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM docs),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
windows AS (SELECT r, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(w, 4) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE whole) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY r),
lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(ls) AS l FROM split) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
line_counts AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM lines GROUP BY r),
counts AS (
  SELECT d.r, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim
  FROM docs d JOIN split USING (r) LEFT JOIN line_counts USING (r) LEFT JOIN covered c USING (r))
"""


def _sql() -> str:
    """The same counts, sketches, fences and verdicts for DuckDB."""
    rates = {name: f"CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END" for name, a, b, _, _ in MEASURES}
    values = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, {value} AS v FROM counts WHERE n_words > 0" for name, value in rates.items())
    at = lambda name, side: f"max(CASE WHEN measure = '{name}' THEN {side} END)"
    inside = " AND ".join([f"1000 * {a} <= {at(name, 'high')} * {b} + {1000 * spare}" + (f" AND 1000 * {a} >= {at(name, 'low')} * {b} - {1000 * spare}" if low else "") for name, a, b, spare, low in MEASURES])
    return f"""WITH {_BASE},
vals AS ({values}),
finest AS (SELECT lang, source, measure, CASE WHEN v < 1000 THEN v ELSE v - v % CAST(10 ** (length(v::VARCHAR) - 3) AS BIGINT) END AS bucket, count(*) AS n FROM vals GROUP BY ALL),
sketch AS (SELECT level, CASE WHEN level > 0 THEN lang ELSE '' END AS lang, CASE WHEN level > 1 THEN source ELSE '' END AS source, measure, bucket, sum(n) AS n FROM finest, range(3) t(level) GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sketch),
quantiles AS (SELECT level, lang, source, measure, max(total) AS n_docs, min(CASE WHEN 100 * upto >= {TAILS[0]} * total THEN bucket END) AS lo, min(CASE WHEN 100 * upto >= 50 * total THEN bucket END) AS mid, min(CASE WHEN 100 * upto >= {TAILS[1]} * total THEN bucket END) AS hi FROM ranked GROUP BY ALL),
fence AS (SELECT *, mid - {FENCE} * greatest(hi - mid, mid - lo, 1) AS low, mid + {FENCE} * greatest(hi - mid, mid - lo, 1) AS high FROM quantiles),
chosen AS (SELECT k.lang, k.source, k.measure, coalesce(a.low, b.low, c.low) AS low, coalesce(a.high, b.high, c.high) AS high
  FROM (SELECT lang, source, measure FROM fence WHERE level = 2) k
  LEFT JOIN fence a ON a.level = 2 AND a.lang = k.lang AND a.source = k.source AND a.measure = k.measure AND a.n_docs >= {ENOUGH}
  LEFT JOIN fence b ON b.level = 1 AND b.lang = k.lang AND b.measure = k.measure AND b.n_docs >= {ENOUGH}
  LEFT JOIN fence c ON c.level = 0 AND c.measure = k.measure),
judged AS (SELECT c.r, {inside} AS inside FROM counts c JOIN chosen USING (lang, source) GROUP BY c.r, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaim),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM based LEFT JOIN judged USING (r)"""


@query("op10_quality_rules", _sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
