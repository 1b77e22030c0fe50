"""Repeated passages of the documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .substrings import remove_repeats


@query("op8_substrings", r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
windows AS (SELECT r, doc_id, i, g FROM (
  SELECT r, doc_id, i, string_agg(w, ' ') OVER o AS g, count(*) OVER o AS n FROM words WINDOW o AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
bad AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT r, i + k AS i FROM bad, range(13) t(k)),
left_over AS (SELECT words.r, string_agg(w, ' ' ORDER BY words.i) AS kept, count(*) AS n FROM words LEFT JOIN gone USING (r, i) WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN left_over USING (r)""")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
