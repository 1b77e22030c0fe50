"""Importance resampling of the documents towards the benchmark."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .importance import BUCKETS, draw, learn_gains, weigh
from .registry import query, table


@query("op11_importance", rf"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS (SELECT r, unnest(ws) AS w FROM docs),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM wanted)),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM vocabulary, crc_table),
source_counts AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) AS s, (SELECT count(*) FROM wanted) AS t),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(y.n, 0) + 1)::DOUBLE * (totals.s + {BUCKETS}) / ((coalesce(x.n, 0) + 1)::DOUBLE * (totals.t + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN source_counts x USING (bucket) LEFT JOIN target_counts y USING (bucket), totals),
weights AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)""")
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gains = learn_gains(docs, table(spark, sf_dir, "benchmark"))
    return draw(weigh(docs, gains).drop("text")).select("doc_id", "n_features", "weight", "score", "rank")
