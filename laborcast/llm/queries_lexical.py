"""Ranked documents for the benchmark items."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lexical import build_index, search
from .registry import query, table

_TERMS = r"list_transform(coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


@query("op13_lexical_search", f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark),
totals AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM docs WHERE len(ts) > 0),
asked AS (SELECT q, t, count(*) AS repeats FROM (SELECT q, unnest(ts) AS t FROM items) GROUP BY q, t),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM postings GROUP BY t), totals),
impacts AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * n) // l))) AS s FROM postings JOIN docs USING (r) JOIN weights USING (t), totals),
scores AS (SELECT q, r, sum(repeats * s)::BIGINT AS score FROM asked JOIN impacts USING (t) GROUP BY q, r),
placed AS (SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed JOIN items USING (q) JOIN docs USING (r) WHERE rank <= 20""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
