"""URL verdicts over the pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .url_filter import host_and_path, judge

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The list of the query: the crawl's own addresses at hosts with one of these labels.
LISTED_LABELS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track"]


@query("op4_url_filter", f"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
keyed AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/+|/index\\.html?|\\.html?)$', '') AS canonical FROM split),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE regexp_matches(host, '(^|\\.)({"|".join(LISTED_LABELS)})\\.') AND canonical <> ''),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM keyed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = host_and_path("url")
    listed = pages.where(host.rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")).select("url")
    return judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")
