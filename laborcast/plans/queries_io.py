"""Sources, exports, quality checks and the batch form of the stream operators."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import posting_text
from ..operators import quality as dq, requirements as req, taxonomy as tax
from ..session import shared_folder
from ..sources import files, payloads, sinks, stores
from ..streaming import postings as stream
from .catalog import query
from .lenses import lens
from .queries_facts import demand_by_code
from .queries_jobs import estimates, posted
from .queries_resolve import REQ_SQL, requirements
from .queries_scalars import case_sql, city_sql, COUNTRY, title_sql
from .queries_text import aliases, skills


def raw_occupations(spark, sf):
    rows = lens(spark, sf, "parts_coded")
    return rows.select(F.concat(F.lit(" "), "soc_code").alias(files.CODE), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("occupation")).alias("Title"),
                       F.col("p_type").alias("Description"), F.col("p_brand").alias("Workplace Example"), F.when(F.col("p_size") % 2 == 0, " y ").otherwise("N").alias("Hot Technology"),
                       F.lit(None).cast("string").alias("In Demand"), F.when(F.col("p_size") % 3 == 0, "IM").when(F.col("p_size") % 3 == 1, "XX").otherwise("LV").alias("Scale ID"),
                       F.concat("p_size", F.when(F.col("p_partkey") % 7 == 0, "?").otherwise("")).alias("Data Value"), F.col("p_type").alias("Element Name"),
                       F.concat(F.lit("T"), "p_partkey").alias("Task ID"), F.concat_ws(" ", "p_type", "p_brand").alias("Task"), F.lit("Core").alias("Task Type"),
                       F.concat_ws(" ", F.lower("p_type"), "occupation").alias("Job Title"), "p_partkey")


@query("s01_occupation_scan", "SELECT soc_code, min(occupation) AS title, arg_min(p_type, p_partkey) AS description FROM parts_coded WHERE p_partkey % 3 <> 0 GROUP BY soc_code")
def _(spark, sf):
    return files.shape_occupations(raw_occupations(spark, sf), order="p_partkey")


@query("p01_blank_rows", "SELECT soc_code, p_partkey FROM parts_coded WHERE p_partkey % 3 <> 0")
def _(spark, sf):
    raw = raw_occupations(spark, sf)
    return raw.select(files.trimmed(raw, files.CODE).alias("soc_code"), files.trimmed(raw, "Title").alias("title"), "p_partkey").where("soc_code <> '' AND title <> ''").drop("title")


@query("s02_task_scan", "SELECT soc_code, concat('T', p_partkey) AS task_id, concat(p_type, ' ', p_brand) AS task_description, 'Core' AS task_type FROM parts_coded")
def _(spark, sf):
    return files.shape_tasks(raw_occupations(spark, sf))


@query("s03_skill_rating_scan", "SELECT soc_code, p_type AS skill_name, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS importance FROM parts_coded WHERE p_size % 3 <> 1")
def _(spark, sf):
    return files.shape_skill_ratings(raw_occupations(spark, sf))


@query("s04_technology_scan", "SELECT soc_code, p_brand AS technology_name, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INT) AS hot_technology, 0 AS in_demand FROM parts_coded")
def _(spark, sf):
    return files.shape_technologies(raw_occupations(spark, sf))


@query("s15_tool_scan", "SELECT soc_code, p_brand AS technology_name, count(*) AS rows FROM parts_coded GROUP BY ALL")
def _(spark, sf):
    return files.shape_technologies(raw_occupations(spark, sf)).groupBy("soc_code", "technology_name").agg(F.count(F.lit(1)).alias("rows"))


@query("s16_title_scan", f"SELECT soc_code, concat(lower(p_type), ' ', occupation) AS title, {title_sql('''concat(lower(p_type), ' ', occupation)''', 'sr\\.?|jr\\.?|senior|junior|lead|principal|staff|chief|head|associate|assistant')} AS title_normalized, '' AS short_title FROM parts_coded")
def _(spark, sf):
    return files.shape_titles(raw_occupations(spark, sf))


NUMBER_SQL = "CASE WHEN try_cast(trim(regexp_replace({0}, '[,$₹]', '', 'g')) AS DOUBLE) > 0 THEN try_cast(trim(regexp_replace({0}, '[,$₹]', '', 'g')) AS DOUBLE) END"


@query("s05_network_scan", f"""
SELECT CAST(posting_id AS VARCHAR) AS job_id, title, {title_sql('title')} AS title_normalized, CASE WHEN location = '' THEN 'Unknown' ELSE {case_sql('lower(location)', COUNTRY, "'Other'")} END AS country, {NUMBER_SQL.format('number_text')} AS salary_min_usd,
  ({NUMBER_SQL.format('number_text')} + posting_id + 1) / 2 AS salary_median_usd FROM raw_postings""")
def _(spark, sf):
    raw = lens(spark, sf, "raw_postings").select(F.col("posting_id").cast("string").alias("job_id"), F.col("title").alias("job_title"), "company", F.col("location").alias("job_location"),
                                                 F.col("number_text").alias("min_salary"), (F.col("posting_id") + 1).cast("string").alias("salary_max"), F.col("date_text").alias("list_date"))
    return files.shape_network_postings(raw, source="network").select("job_id", "title", "title_normalized", "country", "salary_min_usd", "salary_median_usd")


BOARD = {"title": "title", "company": "company", "location": "location", "salary": "salary_text", "experience": "experience_text", "date": "date_text", "id": "job_id"}


def board(spark, sf):
    return lens(spark, sf, "raw_postings").withColumn("job_id", F.col("posting_id").cast("string"))


@query("s06_board_scan", "SELECT CAST(posting_id AS VARCHAR) AS job_id, CASE WHEN location = '' THEN 'India' ELSE trim(split_part(location, ',', 1)) END AS city FROM raw_postings")
def _(spark, sf):
    return files.shape_board_postings(board(spark, sf), source="boards", names=BOARD).select("job_id", "city")


@query("s07_board_json_scan", "SELECT CAST(posting_id AS VARCHAR) AS job_id, 2024 AS listed_year, 6 AS listed_month FROM raw_postings")
def _(spark, sf):
    return files.shape_board_postings(board(spark, sf), source="boards_json", names=BOARD, fixed=(2024, 6)).select("job_id", "listed_year", "listed_month")


@query("s08_lakh_scan", "SELECT CAST(posting_id AS VARCHAR) AS job_id, (posting_id % 40)::DOUBLE * 100000 AS salary_min_inr FROM raw_postings WHERE posting_id % 40 > 0 UNION ALL SELECT CAST(posting_id AS VARCHAR), NULL FROM raw_postings WHERE posting_id % 40 = 0")
def _(spark, sf):
    raw = lens(spark, sf, "raw_postings").select(F.col("posting_id").cast("string").alias("Job_ID"), F.col("title").alias("Job_Title"), (F.col("posting_id") % 40).cast("string").alias("Salary_LPA"))
    return files.shape_tech_postings(raw).select("job_id", "salary_min_inr")


@query("s09_slash_city_scan", "SELECT CAST(posting_id AS VARCHAR) AS job_id, trim(split_part(raw_city, ',', 1)) AS city FROM raw_postings")
def _(spark, sf):
    raw = board(spark, sf).withColumn("location", F.concat_ws("/", "raw_city", F.lit("Elsewhere")))
    return files.shape_board_postings(raw, source="science", names=BOARD, fixed=(2024, 1)).select("job_id", "city")


@query("s10_salary_file", f"SELECT CASE WHEN contains(lower(location), 'india') THEN 'india' ELSE 'global' END AS region, count(*) AS benchmarks, count({NUMBER_SQL.format('number_text')}) AS priced_postings FROM raw_postings GROUP BY 1")
def _(spark, sf):
    raw = lens(spark, sf, "raw_postings").select(F.col("title").alias("job_title"), F.col("location").alias("company_location"), F.col("number_text").alias("salary_usd"), F.col("date_text").alias("posting_date"))
    b, p = files.salary_file(raw, source="salaries")
    return b.groupBy("region").agg(F.count(F.lit(1)).alias("benchmarks")).join(p.groupBy("region").agg(F.count("salary_min_usd").alias("priced_postings")), "region")


@query("s11_ordered_cap", "SELECT posting_id FROM postings")
def _(spark, sf):
    # The caps of the original loaders are left out: every posting of a source counts.
    return lens(spark, sf, "postings").select("posting_id")


def listing_payloads(spark, sf):
    """Pages of at most fifty postings as provider payloads."""
    r = lens(spark, sf, "raw_postings")
    item = F.struct(F.col("posting_id").cast("string").alias("id"), "title", "description", F.struct(F.col("company").alias("display_name")).alias("company"),
                    F.struct(F.array(F.lit("India"), F.col("raw_city")).alias("area")).alias("location"), "contract_time", "contract_type",
                    F.date_format(F.col("posted_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), F.col("salary_max").alias("salary_min"), F.col("salary_min").alias("salary_max"))
    page = r.groupBy(F.floor(F.col("posting_id") / 50).alias("page")).agg(F.collect_list(item).alias("results"))
    return page.select("page", F.to_json(F.struct("results")).alias("payload"))


@query("s17_listing_payloads", f"""
SELECT concat('listings:', posting_id) AS job_id, coalesce({city_sql('raw_city')}, '') AS location, CASE WHEN a > b THEN b ELSE a END AS salary_min, CASE WHEN a > b THEN a ELSE b END AS salary_max FROM (
  SELECT posting_id, raw_city, CASE WHEN round_even(salary_max, 0) BETWEEN 50000 AND 20000000 THEN CAST(round_even(salary_max, 0) AS BIGINT) END AS a, CASE WHEN round_even(salary_min, 0) BETWEEN 50000 AND 20000000 THEN CAST(round_even(salary_min, 0) AS BIGINT) END AS b FROM raw_postings)""")
def _(spark, sf):
    return payloads.listings(listing_payloads(spark, sf), "payload").select("job_id", "location", "salary_min", "salary_max")


@query("s18_fulltext_payloads", "SELECT concat('fulltext:', posting_id) AS job_id FROM raw_postings WHERE posting_id % 9 <> 4")
def _(spark, sf):
    r = lens(spark, sf, "raw_postings")
    item = F.struct(F.col("posting_id").cast("string").alias("job_id"), F.col("title").alias("job_title"), F.col("company").alias("employer_name"), F.col("description").alias("job_description"),
                    F.col("raw_city").alias("job_city"), F.col("salary_min").alias("job_min_salary"), F.col("period").alias("job_salary_period"),
                    F.when(F.col("posting_id") % 9 == 4, "2001-01-01T00:00:00Z").alias("job_offer_expiration_datetime_utc"))
    page = r.groupBy(F.floor(F.col("posting_id") / 50).alias("page")).agg(F.collect_list(item).alias("jobs"))
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.struct("jobs").alias("data")))).otherwise(F.to_json(F.struct(F.col("jobs").alias("data"))))
    return payloads.fulltext(page.select(body.alias("payload")), "payload", now=F.lit("2002-01-01").cast("timestamp")).select("job_id")


@query("s19_histogram_payloads", "SELECT l_partkey, CAST(l_linenumber * 100000 AS BIGINT) AS bound, CAST(count(*) AS INT) AS vacancies FROM lineitem GROUP BY ALL")
def _(spark, sf):
    bars = lens(spark, sf, "SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_partkey, l_linenumber")
    payload = bars.groupBy("l_partkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct((F.col("l_linenumber") * 100000).cast("string"), "n"))).alias("histogram"))).alias("payload"))
    return payloads.salary_histogram(payload, ["l_partkey"], "payload")


@query("s20_estimate_payloads", """
SELECT p_partkey, CAST(round_even(p_retailprice * 1200, 0) AS BIGINT) AS min, CAST(round_even(p_retailprice * 1800, 0) AS BIGINT) AS median, CAST(round_even(p_retailprice * 2400, 0) AS BIGINT) AS max, CAST(p_size AS BIGINT) AS count, 'HIGH' AS label FROM part""")
def _(spark, sf):
    price = F.col("p_retailprice")
    good = F.struct((price * 100).alias("min_salary"), (price * 150).alias("median_salary"), (price * 200).alias("max_salary"), F.lit("MONTH").alias("salary_period"), F.lit("INR").alias("salary_currency"),
                    F.col("p_size").alias("salary_count"), F.lit("high").alias("confidence"))
    bad = F.struct((price * 3).alias("min_salary"), price.alias("median_salary"), price.alias("max_salary"), F.lit("YEAR").alias("salary_period"), F.lit("USD").alias("salary_currency"),
                   F.col("p_size").alias("salary_count"), F.lit("low").alias("confidence"))
    rows = lens(spark, sf, "SELECT p_partkey, p_retailprice, p_size FROM part").select("p_partkey", F.to_json(F.struct(F.array(bad, good).alias("data"))).alias("payload"))
    return payloads.salary_estimate(rows, ["p_partkey"], "payload")


@query("s21_reference_seeds", "SELECT substr(soc_code, 1, 2) AS soc_major_group, count(*) AS postings FROM postings GROUP BY 1")
def _(spark, sf):
    from ..sources.seeds import major_groups

    rows = lens(spark, sf, "postings").select(F.substring("soc_code", 1, 2).alias("soc_major_group"))
    return rows.join(F.broadcast(major_groups(spark)), "soc_major_group").groupBy("soc_major_group").agg(F.count(F.lit(1)).alias("postings"))


def new_store(spark, by, buckets=16):
    return stores.BucketStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", by, buckets=buckets)


@query("s22_keyed_merge", """
SELECT custkey, coalesce(min(posting_id) FILTER (posting_id % 2 = 0), min(posting_id)) AS ignored, coalesce(max(posting_id) FILTER (posting_id % 2 = 1), max(posting_id)) AS replaced FROM postings GROUP BY custkey""")
def _(spark, sf):
    # One half is stored, the other is merged into it, and that batch comes twice.
    rows = lens(spark, sf, "postings").select("custkey", "posting_id")
    kept = {}
    for keep in ("first", "last"):
        store = new_store(spark, ["custkey"])
        for number in (0, 1, 1):
            stores.merge_rows(store, rows.where(F.col("posting_id") % 2 == number), order="posting_id", keep=keep, batch_id=str(number))
        kept[keep] = store.read()
    return kept["first"].withColumnRenamed("posting_id", "ignored").join(kept["last"].withColumnRenamed("posting_id", "replaced"), "custkey")


@query("s23_occupation_documents")
def _(spark, sf):
    return sinks.occupation_documents(lens(spark, sf, "occupations"), requirements(spark, sf)).select("soc_code", "total_requirements", "sha256")


PARTS_SQL = f"""{REQ_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY coalesce(importance_norm, 0) DESC, item_type, item_name) - 1 AS place FROM unified),
parts AS (SELECT soc_code, place // 200 AS part, count(*) AS items, sha256(string_agg(to_json({{'item_type': item_type, 'item_name': item_name, 'importance': CASE WHEN importance_norm IS NOT NULL THEN printf('%.4f', importance_norm) END}})::VARCHAR, chr(10) ORDER BY place)) AS sha256 FROM placed GROUP BY ALL)"""


@query("s23_document_parts", f"WITH {PARTS_SQL} SELECT soc_code, part, items, sha256 FROM parts")
def _(spark, sf):
    return sinks.document_parts(requirements(spark, sf), size=200).select("soc_code", "part", "items", "sha256")


@query("s23_document_manifest", f"""
WITH {PARTS_SQL} SELECT o.soc_code, o.title, count(*) AS parts, CAST(sum(items) AS BIGINT) AS items, sha256(string_agg(p.sha256, '' ORDER BY part)) AS sha256 FROM occupations o JOIN parts p USING (soc_code) GROUP BY ALL""")
def _(spark, sf):
    return sinks.document_manifest(lens(spark, sf, "occupations"), sinks.document_parts(requirements(spark, sf), size=200))


@query("s24_build_metadata", """
SELECT '2.2.0' AS schema_version, concat('{"orders":', (SELECT count(*) FROM orders), ',"parts":', (SELECT count(*) FROM part), '}') AS table_counts""")
def _(spark, sf):
    return sinks.latest_build(sinks.table_counts({"orders": lens(spark, sf, "SELECT o_orderkey FROM orders"), "parts": lens(spark, sf, "SELECT p_partkey FROM part")}, version="2.2.0"))


@query("m03_snapshot_partitions", """
SELECT role, location_raw, count(*) AS rows FROM (SELECT *, max(fetched_at) OVER (PARTITION BY role, location_raw) AS newest FROM snapshots) WHERE fetched_at = newest GROUP BY ALL""")
def _(spark, sf):
    # Both fetches of every market go through the sink; the older one comes last and must not replace the newer.
    rows = lens(spark, sf, "SELECT job_id, role, location_raw, source, fetched_at FROM snapshots")
    store = new_store(spark, ["role", "location_raw"])
    for source in ("fulltext", "listings"):
        stores.replace_snapshots(store, rows.where(F.col("source") == source), batch_id=source)
    return store.read().groupBy("role", "location_raw").agg(F.count(F.lit(1)).alias("rows"))


# --- the stream operators over the same rows at once -----------------------------------------------

def event_postings(spark, sf, times=None):
    e = lens(spark, sf, "events")
    return e.select(F.col("event_type").alias("role"), F.concat_ws(" ", "event_type", F.lit("specialist")).alias("title"), F.concat(F.lit("Company "), "user_id").alias("company"),
                    F.concat(F.lit("City "), F.get_json_object("props", "$.k")).alias("location"), F.lit("2+ years, remote").alias("description"), (F.col("value") * 100000).alias("salary"),
                    *(times or [F.col("ts").cast("timestamp").alias("posted_at")]))


@query("r01_normalized_stream", """
SELECT user_id, event_type, count(*) AS rows, count(CASE WHEN round_even(value * 100000, 0) BETWEEN 50000 AND 20000000 THEN 1 END) AS paid FROM events GROUP BY ALL""")
def _(spark, sf):
    out = stream.normalized(event_postings(spark, sf))
    return out.groupBy(F.split_part("company", F.lit(" "), F.lit(2)).cast("long").alias("user_id"), F.split_part("title", F.lit(" "), F.lit(1)).alias("event_type")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("salary").alias("paid"))


@query("r02_first_copies", "SELECT count(DISTINCT (event_type, user_id, props)) AS postings FROM events")
def _(spark, sf):
    # One month of events lies inside the 45-day horizon, so a batch keeps one copy per key as the stream does.
    kept = stream.first_copies(stream.normalized(event_postings(spark, sf)))
    return kept.agg(F.count("duplicate_key").alias("postings"))


@query("r04_dated_and_undated_copies", """
SELECT dated, count(*) AS postings FROM (SELECT DISTINCT event_id % 4 <> 0 AS dated, event_type, user_id, props FROM events) GROUP BY dated""")
def _(spark, sf):
    # Every fourth event has no date, only the time at which it was fetched.
    time = F.col("ts").cast("timestamp")
    posts = event_postings(spark, sf, [F.when(F.col("event_id") % 4 != 0, time).alias("posted_at"), time.alias("fetched_at")])
    kept = stream.all_first_copies(stream.normalized(posts))
    return kept.groupBy(F.col("posted_at").isNotNull().alias("dated")).agg(F.count(F.lit(1)).alias("postings"))


@query("r03_posting_velocity", "SELECT event_type AS role, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS postings FROM events GROUP BY ALL")
def _(spark, sf):
    out = stream.velocity(event_postings(spark, sf), size="1 day")
    return out.select("role", F.floor(F.unix_timestamp("window_start") / 86400).alias("day"), "postings")


@query("r03_sliding_velocity")
def _(spark, sf):
    return stream.velocity(event_postings(spark, sf), size="7 days", slide="1 day")


@query("r04_late_rows", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def _(spark, sf):
    from ..operators.postings import unexpired

    rows = lens(spark, sf, "SELECT event_id, ts AS posted_at FROM events")
    return unexpired(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), days=10).select("event_id")


@query("r05_latest_market_rows", "SELECT event_type AS role, user_id, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY event_type, user_id) AS newest FROM events) WHERE ts = newest GROUP BY ALL")
def _(spark, sf):
    from ..operators.postings import current_snapshots

    rows = lens(spark, sf, "SELECT event_id, event_type AS role, user_id, ts AS fetched_at FROM events")
    return current_snapshots(rows, ["role", "user_id"], F.lit("2024-02-01").cast("timestamp")).groupBy("role", "user_id").agg(F.max("event_id").alias("event_id"))


# --- quality --------------------------------------------------------------------------------------

@query("d01_coverage", "SELECT count(*) AS rows, count(DISTINCT occupation) AS distinct_values FROM postings HAVING count(DISTINCT occupation) < 1000")
def _(spark, sf):
    return dq.coverage(lens(spark, sf, "postings"), "occupation", min_distinct=1000, min_rows=1)


@query("d02_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return dq.repeated_keys(lens(spark, sf, "SELECT l_orderkey, l_linenumber FROM lineitem"), ["l_orderkey", "l_linenumber"])


@query("d03_forbidden_terms", "SELECT posting_id, skill_name FROM skill_mentions WHERE lower(skill_name) IN ('gender', 'bonus')")
def _(spark, sf):
    terms = spark.createDataFrame([("Gender",), ("bonus",)], "term string")
    return dq.forbidden_terms(lens(spark, sf, "skill_mentions"), "skill_name", terms).select("posting_id", "skill_name")


@query("d04_ordered_bounds", "SELECT posting_id FROM postings WHERE NOT coalesce(salary_min <= salary_max, false)")
def _(spark, sf):
    return dq.violations(lens(spark, sf, "postings"), F.col("salary_min") <= F.col("salary_max")).select("posting_id")


@query("d05_flag_has_reason", "SELECT task_id FROM tasks WHERE contains(lower(task_description), 'prescribe') AND soc_code NOT IN ('29-1140.00', '29-1141.00') AND NOT contains(lower(task_description), '401(k)')")
def _(spark, sf):
    # A task that mentions prescribing is flagged here; the reason exists only for the reserved codes.
    text = F.lower("task_description")
    reason = req.irrelevance_reason(F.col("soc_code"), F.col("task_description"), foreign=True, reserved_codes=["29-1140.00", "29-1141.00"])
    rows = lens(spark, sf, "tasks").withColumn("reason", reason)
    return dq.violations(rows, ~text.contains("prescribe") | F.col("reason").isNotNull()).select("task_id")


@query("d06_orphan_skills", "SELECT posting_id, skill_normalized FROM skill_mentions WHERE skill_normalized NOT IN (SELECT id FROM skills)")
def _(spark, sf):
    return dq.orphans(lens(spark, sf, "skill_mentions"), "skill_normalized", skills(spark, sf), "id").select("posting_id", "skill_normalized")


@query("d07_thin_entities", "SELECT soc_code, count(*) FILTER (importance >= 40) AS strong FROM tasks GROUP BY soc_code HAVING count(*) FILTER (importance >= 40) < 6")
def _(spark, sf):
    rows = lens(spark, sf, "tasks").withColumn("item_type", F.when(F.col("importance") >= 40, "strong").otherwise("weak"))
    return dq.thin_entities(rows, ["soc_code"], {"strong": 6})
