"""Fact tables over the postings and skill lenses."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, places, titles
from ..operators import containment, facts, ranks
from .catalog import query
from .lenses import lens, values
from .queries_scalars import SPLIT_SQL, canonical_city_sql, initcap_sql, map_sql, slug_sql, title_sql

GENERIC_SQL = ", ".join(f"'{s}'" for s in facts.GENERIC_SKILLS)

# Search terms of a title, as DuckDB text over (role, phrase).
_WORDS = r"list_filter(regexp_split_to_array(phrase, '\s+'), lambda w: length(w) > 2)"
TERMS_SQL = rf"""
roles AS (SELECT title AS role, soc_code, trim(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g')) AS phrase FROM occupations),
terms AS (SELECT role, soc_code, phrase, coalesce({_WORDS}[1], phrase) AS first_word, coalesce({_WORDS}[-1], phrase) AS last_word,
  CASE WHEN contains(phrase, 'data entry') THEN 'data entry'
    WHEN contains(phrase, 'software') AND (contains(phrase, 'dev') OR contains(phrase, 'eng')) THEN 'software'
    WHEN contains(phrase, 'machine learning') THEN 'machine learning'
    WHEN contains(phrase, 'data scientist') OR contains(phrase, 'data science') THEN 'data scientist'
    WHEN contains(phrase, 'customer service') OR contains(phrase, 'customer support') THEN 'customer service'
    WHEN contains(phrase, 'nurse') THEN 'nurse' WHEN contains(phrase, 'electrician') THEN 'electrician'
    WHEN contains(phrase, 'accountant') THEN 'accountant'
    WHEN contains(phrase, 'telemarketer') OR contains(phrase, 'telecaller') THEN 'telemarket'
    WHEN len({_WORDS}) >= 2 THEN concat({_WORDS}[1], ' ', {_WORDS}[2])
    WHEN len({_WORDS}) = 1 THEN {_WORDS}[1] ELSE phrase END AS pattern FROM roles)"""


def role_terms(spark, sf):
    return facts.search_terms(lens(spark, sf, "occupations").withColumn("role", F.col("title")), "title")


def normalized_postings(spark, sf):
    return lens(spark, sf, "postings").withColumn("title_normalized", titles.normalize_title(F.col("title")))


NORMALIZED_SQL = f"np AS (SELECT *, {title_sql('title')} AS title_normalized FROM postings)"


@query("p05_search_terms", f"WITH {TERMS_SQL} SELECT role, phrase, first_word, last_word, pattern FROM terms")
def _(spark, sf):
    return role_terms(spark, sf).select("role", "phrase", "first_word", "last_word", "pattern")


@query("a01_regional_years", """
SELECT region, year, count(*) AS total_postings, count(DISTINCT company) AS unique_employers,
  round(avg(salary_min), 2) AS avg_salary_min, round(avg(salary_max), 2) AS avg_salary_max
FROM (SELECT *, coalesce(listed_year, 2024) AS year FROM postings) GROUP BY region, year""")
def _(spark, sf):
    return facts.regional_years(lens(spark, sf, "postings")).withColumn("avg_salary_min", F.round("avg_salary_min", 2)) \
        .withColumn("avg_salary_max", F.round("avg_salary_max", 2))


@query("u01_two_region_union", """
SELECT region, posting_id, title FROM postings WHERE region = 'india' UNION ALL
SELECT region, posting_id, title FROM postings WHERE region = 'global'""")
def _(spark, sf):
    rows = lens(spark, sf, "postings").select("region", "posting_id", "title")
    return rows.where("region = 'india'").unionByName(rows.where("region = 'global'"))


@query("a02_skill_comparison", """
SELECT skill_normalized, region, CAST(sum(frequency) AS BIGINT) AS total_demand, count(DISTINCT year) AS years_active
FROM skill_mentions GROUP BY skill_normalized, region""")
def _(spark, sf):
    return facts.skill_comparison(lens(spark, sf, "skill_mentions"))


@query("j13_title_containment", f"""
WITH {TERMS_SQL} SELECT t.pattern, p.posting_id FROM (SELECT DISTINCT pattern FROM terms) t JOIN postings p ON contains(lower(p.title), t.pattern)""")
def _(spark, sf):
    return facts.matched_postings(role_terms(spark, sf), "pattern", lens(spark, sf, "postings")).select("pattern", "posting_id")


@query("p02_case_insensitive_substring", f"""
WITH {TERMS_SQL} SELECT t.last_word, p.title, count(*) AS postings FROM (SELECT DISTINCT last_word FROM terms) t
JOIN postings p ON contains(lower(p.title), t.last_word) GROUP BY 1, 2""")
def _(spark, sf):
    return facts.matched_postings(role_terms(spark, sf), "last_word", lens(spark, sf, "postings")) \
        .groupBy("last_word", "title").agg(F.count(F.lit(1)).alias("postings"))


@query("p03_two_way_containment", f"""
WITH {TERMS_SQL}, t AS (SELECT DISTINCT {title_sql('title')} AS title_normalized FROM postings)
SELECT DISTINCT r.phrase, t.title_normalized FROM terms r JOIN t ON contains(t.title_normalized, r.phrase) OR contains(r.phrase, t.title_normalized)""")
def _(spark, sf):
    return containment.two_way_join(role_terms(spark, sf), "phrase", normalized_postings(spark, sf), "title_normalized")


@query("p04_token_and_or", f"""
WITH q AS (SELECT DISTINCT title AS role, string_split(lower(title), ' ') AS tokens FROM occupations),
t AS (SELECT DISTINCT lower(title) AS posting_title FROM postings),
h AS (SELECT q.role, t.posting_title, len(list_filter(list_distinct(q.tokens), lambda k: contains(t.posting_title, k))) AS hits, len(list_distinct(q.tokens)) AS n FROM q, t)
SELECT role, posting_title, hits, hits = n AS has_all FROM h WHERE hits >= 1""")
def _(spark, sf):
    roles = lens(spark, sf, "occupations").select(F.col("title").alias("role"), F.split(F.lower("title"), " ").alias("tokens"))
    texts = lens(spark, sf, "postings").select(F.lower("title").alias("posting_title"))
    hits = containment.any_token_join(roles, "role", "tokens", texts, "posting_title")
    return hits.join(roles, "role").select("role", "posting_title", "hits", (F.col("hits") == F.size(F.array_distinct("tokens"))).alias("has_all"))


VOLUMES_SQL = f"""{TERMS_SQL},
posting_titles AS (SELECT DISTINCT title FROM postings),
title_hits AS (SELECT DISTINCT t.pattern, x.title FROM terms t JOIN posting_titles x ON contains(lower(x.title), t.pattern)),
matched AS (SELECT h.pattern, p.* FROM title_hits h JOIN postings p USING (title))"""


def volumes(spark, sf):
    matched = facts.matched_postings(role_terms(spark, sf), "pattern", lens(spark, sf, "postings"))
    return facts.posting_volumes(matched, "pattern")


@query("a03_global_posting_history", f"""
WITH {VOLUMES_SQL} SELECT pattern, count(*) AS total, count(DISTINCT company) AS unique_companies,
  round(avg((salary_min + salary_max) / 2), 2) AS avg_salary_mid, count(*) FILTER (WHERE listed_year = 2024) AS postings_2024, count(*) FILTER (WHERE listed_year >= 2025) AS postings_2025_plus
FROM matched WHERE region = 'global' GROUP BY pattern""")
def _(spark, sf):
    return volumes(spark, sf).where("region = 'global'").select(
        "pattern", "total", "unique_companies", F.round("avg_salary_mid", 2).alias("avg_salary_mid"), "postings_2024", "postings_2025_plus")


@query("a04_home_posting_history", f"""
WITH {VOLUMES_SQL} SELECT pattern, count(*) AS total, count(DISTINCT company) AS unique_companies,
  round(avg(salary_min), 2) AS avg_min_inr, round(avg(salary_max), 2) AS avg_max_inr, round(avg(salary_min) * 0.012::DOUBLE, 2) AS avg_min_usd,
  count(*) FILTER (WHERE listed_year <= 2017) AS historical_postings, count(*) FILTER (WHERE listed_year >= 2024) AS modern_postings
FROM matched WHERE region = 'india' GROUP BY pattern""")
def _(spark, sf):
    return volumes(spark, sf).where("region = 'india'").select(
        "pattern", "total", "unique_companies", F.round("avg_salary_min", 2).alias("avg_min_inr"), F.round("avg_salary_max", 2).alias("avg_max_inr"),
        F.round(F.col("avg_salary_min") * numbers.INR_TO_USD, 2).alias("avg_min_usd"), "historical_postings", "modern_postings")


@query("t01_top_places", f"""
WITH {VOLUMES_SQL}, c AS (SELECT pattern, region, concat('NATION_', CAST(nationkey AS VARCHAR)) AS city, count(*) AS cnt FROM matched GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern, region ORDER BY cnt DESC, city) AS i FROM c)
SELECT pattern, region, array_to_string(list_transform(list_sort(list({{'i': i, 'city': city, 'cnt': cnt}})), lambda x: concat(x.city, ' (', CAST(x.cnt AS VARCHAR), ')')), '; ') AS top_places
FROM r WHERE i <= 5 GROUP BY pattern, region""")
def _(spark, sf):
    matched = facts.matched_postings(role_terms(spark, sf), "pattern", lens(spark, sf, "postings"))
    return facts.top_places(matched, "pattern").withColumn("top_places", F.array_join("top_places", "; "))


@query("a05_yearly_counts", f"""
WITH {TERMS_SQL} SELECT t.first_word, p.region, p.listed_year AS year, count(*) AS postings FROM (SELECT DISTINCT first_word FROM terms) t
JOIN postings p ON contains(lower(p.title), t.first_word) WHERE p.listed_year IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return facts.yearly_counts(facts.matched_postings(role_terms(spark, sf), "first_word", lens(spark, sf, "postings")), "first_word")


@query("a06_demand_by_context", """
SELECT lower(occupation_context) AS context, region, skill_normalized, CAST(sum(frequency) AS BIGINT) AS freq FROM skill_mentions GROUP BY ALL""")
def _(spark, sf):
    return facts.demand_by_context(lens(spark, sf, "skill_mentions"))


# The role set of the skill queries: every occupation plus shorter and longer wordings, so every stage occurs.
SKILL_ROLES = """SELECT title AS role FROM occupations UNION ALL SELECT concat('night ', title) FROM occupations
UNION ALL SELECT DISTINCT concat('zebra ', substr(title, strpos(title, ' ') + 1)) FROM occupations UNION ALL SELECT DISTINCT concat(substr(title, 1, strpos(title, ' ') - 1), ' zzyzx') FROM occupations"""


def skill_roles(spark, sf):
    base = lens(spark, sf, "occupations").select("title")
    space = F.instr("title", " ")
    tail = F.concat(F.lit("zebra "), F.substr("title", space + 1))
    head = F.concat(F.substring_index("title", " ", 1), F.lit(" zzyzx"))
    roles = base.unionAll(base.select(F.concat(F.lit("night "), "title"))).unionAll(base.select(tail).distinct()).unionAll(base.select(head).distinct())
    return facts.search_terms(roles.withColumn("role", F.col("title")), "title")


STAGED_SQL = rf"""
sroles AS ({SKILL_ROLES}),
sphrase AS (SELECT role, trim(regexp_replace(lower(role), '[^a-z0-9\s]', '', 'g')) AS phrase FROM sroles),
sterms AS (SELECT role, phrase, coalesce({_WORDS}[-1], phrase) AS last_word FROM sphrase),
demand AS (SELECT lower(occupation_context) AS context, region, skill_normalized, CAST(sum(frequency) AS BIGINT) AS freq FROM skill_mentions GROUP BY ALL),
hits AS (SELECT s.role, d.region, 1 AS stage, d.skill_normalized, d.freq FROM sterms s JOIN demand d ON contains(d.context, s.phrase) OR contains(s.phrase, d.context)
  UNION ALL SELECT s.role, d.region, 2, d.skill_normalized, d.freq FROM sterms s JOIN demand d ON contains(d.context, s.last_word)),
freqs AS (SELECT role, region, stage, skill_normalized, CAST(sum(freq) AS BIGINT) AS freq FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role, region, stage ORDER BY freq DESC, skill_normalized) AS position FROM freqs),
cut AS (SELECT *, count(*) FILTER (WHERE stage = 1) OVER (PARTITION BY role, region) AS n1 FROM ranked WHERE position <= 40),
staged AS (SELECT role, region, stage, skill_normalized, freq, position FROM cut WHERE (stage = 1) = (n1 >= 4))"""


@query("j14_context_containment", f"""
WITH {STAGED_SQL} SELECT DISTINCT s.phrase, d.context FROM sterms s JOIN demand d ON contains(d.context, s.phrase) OR contains(s.phrase, d.context)""")
def _(spark, sf):
    return facts.context_pairs(skill_roles(spark, sf), lens(spark, sf, "skill_mentions"))


@query("t02_staged_top_skills", f"WITH {STAGED_SQL} SELECT * FROM staged")
def _(spark, sf):
    return facts.staged_skills(skill_roles(spark, sf), lens(spark, sf, "skill_mentions"))


@query("p09_generic_skills_removed", f"SELECT posting_id, skill_normalized FROM skill_mentions WHERE skill_normalized NOT IN ({GENERIC_SQL})")
def _(spark, sf):
    return lens(spark, sf, "skill_mentions").where(~F.col("skill_normalized").isin(facts.GENERIC_SKILLS)).select("posting_id", "skill_normalized")


ROLE_SKILLS_SQL = f"""{STAGED_SQL},
useful AS (SELECT role, region, skill_normalized, freq, row_number() OVER (PARTITION BY role, region ORDER BY freq DESC, skill_normalized) AS position
  FROM staged WHERE skill_normalized NOT IN ({GENERIC_SQL})),
topped AS (SELECT * FROM useful WHERE position <= 8),
general AS (SELECT region, skill_normalized, freq, row_number() OVER (PARTITION BY region ORDER BY freq DESC, skill_normalized) AS position FROM (
  SELECT * FROM (SELECT region, skill_normalized, CAST(sum(frequency) AS BIGINT) AS freq, row_number() OVER (PARTITION BY region ORDER BY sum(frequency) DESC, skill_normalized) AS i
    FROM skill_mentions GROUP BY region, skill_normalized) WHERE i <= 40 AND skill_normalized NOT IN ({GENERIC_SQL}))),
role_tops AS (SELECT * FROM topped UNION ALL
  SELECT r.role, r.region, g.skill_normalized, g.freq, g.position FROM (SELECT role, unnest(['india', 'global']) AS region FROM sterms) r
  JOIN general g ON g.region = r.region AND g.position <= 8
  WHERE NOT EXISTS (SELECT 1 FROM topped t WHERE t.role = r.role AND t.region = r.region))"""


@query("o15_role_skills", f"WITH {ROLE_SKILLS_SQL} SELECT * FROM role_tops")
def _(spark, sf):
    return facts.role_skills(skill_roles(spark, sf), lens(spark, sf, "skill_mentions"), ["india", "global"])


@query("a24_skill_weights", f"""
WITH {STAGED_SQL}, t AS (SELECT role, skill_normalized, CAST(sum(freq) AS BIGINT) AS freq FROM staged WHERE skill_normalized NOT IN ({GENERIC_SQL}) GROUP BY ALL)
SELECT role, skill_normalized, freq, round(freq / max(freq) OVER (PARTITION BY role), 4) AS weight FROM t""")
def _(spark, sf):
    return facts.skill_weights(facts.staged_skills(skill_roles(spark, sf), lens(spark, sf, "skill_mentions")))


NOISE_ROWS = [("gender", "eeo"), ("communication", "generic"), ("bonus", "generic"), ("medical", "generic"), ("level", "generic"), ("it hardware", "industry")]
NOISE_SQL = f"""
noise_base AS ({values(NOISE_ROWS, 'term, category')}),
noise_all AS (SELECT lower(trim(term)) AS term, category, 0 AS pri FROM noise_base
  UNION ALL SELECT replace(lower(trim(term)), ' ', '_'), category, 0 FROM noise_base
  UNION ALL SELECT lower(trim(raw_city)), 'location', 1 FROM city_names UNION ALL SELECT replace(lower(trim(raw_city)), ' ', '_'), 'location', 1 FROM city_names
  UNION ALL SELECT lower(trim(title)), 'occupation_title', 2 FROM occupations WHERE length(trim(title)) > 3
  UNION ALL SELECT replace(lower(trim(title)), ' ', '_'), 'occupation_title', 2 FROM occupations WHERE length(trim(title)) > 3
  UNION ALL SELECT lower(trim(raw_title)), 'occupation_title', 3 FROM title_aliases WHERE length(trim(raw_title)) > 3
  UNION ALL SELECT replace(lower(trim(raw_title)), ' ', '_'), 'occupation_title', 3 FROM title_aliases WHERE length(trim(raw_title)) > 3),
noise AS (SELECT term, arg_max(category, pri) AS category FROM noise_all WHERE term <> '' GROUP BY term)"""


def noise_terms(spark, sf):
    from ..operators.requirements import noise_dictionary

    base = spark.createDataFrame(NOISE_ROWS, "term string, category string")
    return noise_dictionary([
        (base, "term", None, 0), (lens(spark, sf, "city_names"), "raw_city", "location", 0),
        (lens(spark, sf, "occupations"), "title", "occupation_title", 3), (lens(spark, sf, "title_aliases"), "raw_title", "occupation_title", 3)])


@query("u07_noise_dictionary", f"WITH {NOISE_SQL} SELECT term, category FROM noise")
def _(spark, sf):
    return noise_terms(spark, sf)


@query("u03_city_name_union", f"""
SELECT DISTINCT lower(trim(c)) AS city FROM (SELECT raw_city AS c FROM raw_postings UNION SELECT {canonical_city_sql('raw_city', 1)} FROM raw_postings)""")
def _(spark, sf):
    rows = lens(spark, sf, "raw_postings").select("raw_city").distinct()
    canonical = rows.select(places.canonical_city(F.col("raw_city"))["city_canonical"].alias("raw_city"))
    return rows.union(canonical).select(F.lower(F.trim("raw_city")).alias("city")).distinct()


CLEAN_SQL = f"""{NOISE_SQL},
clean AS (SELECT * FROM skill_mentions WHERE lower(skill_normalized) NOT IN (SELECT term FROM noise) AND lower(skill_name) NOT IN (SELECT term FROM noise)
  AND NOT regexp_matches(skill_normalized, '[0-9]') AND (length(skill_normalized) > 1 OR skill_normalized IN ('c', 'r')))"""


@query("p07_clean_mentions", f"WITH {CLEAN_SQL} SELECT posting_id, skill_name, skill_normalized, soc_code FROM clean")
def _(spark, sf):
    return facts.clean_mentions(lens(spark, sf, "skill_mentions"), noise_terms(spark, sf)).select("posting_id", "skill_name", "skill_normalized", "soc_code")


@query("p08_skill_shape", """
SELECT posting_id, skill_normalized FROM skill_mentions WHERE NOT regexp_matches(skill_normalized, '[0-9]')
  AND (length(skill_normalized) > 1 OR skill_normalized IN ('c', 'r')) AND length(skill_normalized) < 50""")
def _(spark, sf):
    s = F.col("skill_normalized")
    return lens(spark, sf, "skill_mentions").where(~s.rlike("[0-9]") & ((F.length(s) > 1) | s.isin("c", "r")) & (F.length(s) < 50)).select("posting_id", s)


@query("a08_postings_per_code", "SELECT soc_code, region, count(DISTINCT posting_id) AS postings FROM postings GROUP BY ALL")
def _(spark, sf):
    return facts.postings_per_code(lens(spark, sf, "postings"))


DEMAND_SQL = f"""{CLEAN_SQL},
totals AS (SELECT soc_code, region, count(DISTINCT posting_id) AS postings FROM postings GROUP BY ALL),
grouped AS (SELECT soc_code, region, skill_normalized, CAST(sum(frequency) AS BIGINT) AS mentions, min(year) AS first_year, max(year) AS last_year FROM clean GROUP BY ALL HAVING sum(frequency) >= 3),
demand_rows AS (SELECT g.soc_code, g.region, g.skill_normalized, g.mentions, g.first_year, g.last_year, g.mentions AS posting_count,
  greatest(g.mentions, coalesce(t.postings, 0), 1) AS soc_posting_total, round(g.mentions / greatest(g.mentions, coalesce(t.postings, 0), 1), 4) AS share_of_postings,
  coalesce({map_sql('lower(skill_normalized)', titles.DISPLAY_NAMES)}, {initcap_sql("replace(skill_normalized, '_', ' ')")}) AS skill_name, concat(g.region, '_postings') AS source,
  row_number() OVER (PARTITION BY g.soc_code, g.region ORDER BY g.mentions DESC, g.skill_normalized) AS position
  FROM grouped g LEFT JOIN totals t USING (soc_code, region)),
demand50 AS (SELECT * FROM demand_rows WHERE position <= 50)"""


def demand_by_code(spark, sf):
    clean = facts.clean_mentions(lens(spark, sf, "skill_mentions"), noise_terms(spark, sf))
    return facts.skill_demand_by_code(clean, facts.postings_per_code(lens(spark, sf, "postings")))


@query("a07_skill_demand_by_code", f"WITH {DEMAND_SQL} SELECT * EXCLUDE (position) FROM demand50")
def _(spark, sf):
    return demand_by_code(spark, sf).drop("position")


@query("w01_top_skills_per_code", f"WITH {DEMAND_SQL} SELECT soc_code, region, skill_normalized, posting_count, position FROM demand_rows WHERE position <= 10")
def _(spark, sf):
    clean = facts.clean_mentions(lens(spark, sf, "skill_mentions"), noise_terms(spark, sf))
    return facts.skill_demand_by_code(clean, facts.postings_per_code(lens(spark, sf, "postings")), keep=10) \
        .select("soc_code", "region", "skill_normalized", "posting_count", "position")


@query("w02_demand_importance", f"""
WITH {DEMAND_SQL} SELECT soc_code, region, skill_normalized, round(greatest(0.2, least(1.0, posting_count / greatest(1, max(posting_count) OVER (PARTITION BY soc_code, region)))), 4) AS importance_norm FROM demand50""")
def _(spark, sf):
    return facts.demand_importance(demand_by_code(spark, sf)).select("soc_code", "region", "skill_normalized", "importance_norm")


CURATED = [("15-2050.00", "python", "Python"), ("29-1140.00", "nursing", "General Nursing"), ("35-1010.00", "excel", "Advanced Excel")]


@query("u08_observed_and_curated", f"""
WITH {DEMAND_SQL}, cur AS ({values(CURATED, 'soc_code, skill_normalized, skill_name')})
SELECT soc_code, region, skill_normalized, skill_name, posting_count, share_of_postings, source FROM demand50
UNION ALL SELECT soc_code, 'curated', skill_normalized, skill_name, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 'curated' FROM cur""")
def _(spark, sf):
    curated = spark.createDataFrame(CURATED, "soc_code string, skill_normalized string, skill_name string")
    return facts.add_curated(demand_by_code(spark, sf), curated)


ZONES = "CASE substr(soc_code, 1, 2) WHEN '15' THEN 5 WHEN '29' THEN 3 WHEN '53' THEN 2 WHEN '35' THEN NULL ELSE 4 END"


@query("a10_experience_by_code", f"""
WITH o AS (SELECT soc_code, CAST({ZONES} AS INT) AS job_zone FROM occupations),
r AS (SELECT * FROM postings WHERE experience_min IS NOT NULL AND listed_year >= 2023),
g AS (SELECT soc_code, count(*) AS n, avg(experience_min) AS a, avg(experience_max) AS b, avg(experience_min + 3) AS c, concat(min(listed_year), '-', max(listed_year)) AS y, list_sort(list(experience_min)) AS s FROM r GROUP BY soc_code)
SELECT o.soc_code,
  CASE WHEN n >= 30 THEN greatest(0.0, round(a, 1)) ELSE CASE job_zone WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 WHEN 4 THEN 3.0 WHEN 5 THEN 5.0 ELSE 1.0 END END::DOUBLE AS typical_min,
  CASE WHEN n >= 30 THEN greatest(greatest(0.0, round(a, 1)) + 1, round(coalesce(b, c), 1)) ELSE CASE job_zone WHEN 1 THEN 1.0 WHEN 2 THEN 2.5 WHEN 3 THEN 4.5 WHEN 4 THEN 7.0 WHEN 5 THEN 10.0 ELSE 4.0 END END::DOUBLE AS typical_max,
  CASE WHEN n >= 30 THEN round(s[CAST(floor(n * 0.25) AS INT) + 1], 1) ELSE CASE job_zone WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.5 WHEN 4 THEN 2.5 WHEN 5 THEN 4.0 ELSE 1.0 END END::DOUBLE AS p25_min,
  CASE WHEN n >= 30 THEN round(s[CAST(floor(n * 0.5) AS INT) + 1], 1) ELSE CASE job_zone WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 3.0 WHEN 4 THEN 4.5 WHEN 5 THEN 6.5 ELSE 2.0 END END::DOUBLE AS median_min,
  coalesce(n, 0) AS sample_size, y AS years_covered, CASE WHEN coalesce(n, 0) >= 30 THEN 0 ELSE 1 END AS fallback_to_job_zone
FROM o LEFT JOIN g USING (soc_code)""")
def _(spark, sf):
    occ = lens(spark, sf, f"SELECT soc_code, CAST({ZONES} AS INT) AS job_zone FROM occupations")
    return facts.experience_by_code(lens(spark, sf, "postings"), occ)


@query("p11_recent_with_experience", "SELECT posting_id FROM postings WHERE listed_year >= 2023 AND experience_min IS NOT NULL")
def _(spark, sf):
    return lens(spark, sf, "postings").where((F.col("listed_year") >= 2023) & F.col("experience_min").isNotNull()).select("posting_id")


CODED_SQL = f"coded AS (SELECT soc_code, raw_city AS city, {canonical_city_sql('raw_city', 1)} AS city_canonical, experience_min, salary_min, salary_max, listed_year FROM raw_postings)"


def coded_postings(spark, sf):
    return lens(spark, sf, "raw_postings").select("posting_id", "soc_code", F.col("raw_city").alias("city"), places.canonical_city(F.col("raw_city"))["city_canonical"].alias("city_canonical"),
                                                  "experience_min", "salary_min", "salary_max", "listed_year")


@query("j04_postings_with_city", f"WITH {CODED_SQL} SELECT soc_code, city, city_canonical, experience_min, listed_year FROM coded")
def _(spark, sf):
    from ..operators.resolve import postings_with_city

    rows = lens(spark, sf, "raw_postings").select("posting_id", F.col("raw_city").alias("city"), "experience_min", "listed_year")
    code_map = lens(spark, sf, "raw_postings").select("posting_id", "soc_code")
    return postings_with_city(rows, code_map).select("soc_code", "city", "city_canonical", "experience_min", "listed_year")


CUBE_SQL = f"""{CODED_SQL},
paid AS (SELECT soc_code, coalesce(city_canonical, 'Other') AS city, CASE WHEN experience_min <= 2.5 THEN 'entry' WHEN experience_min <= 6 THEN 'mid' ELSE 'senior' END AS band,
  CASE WHEN contains(lower(city), 'remote') THEN 'remote' ELSE 'onsite' END AS work_mode, coalesce((salary_min + salary_max) / 200000.0, salary_min / 100000.0) AS lpa, listed_year
  FROM coded WHERE coalesce(salary_min, salary_max) > 100000)
SELECT soc_code, CASE WHEN grouping(city) = 1 THEN 'All India' ELSE city END AS city_canonical, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS experience_bucket, work_mode,
  round(list_sort(list(lpa))[CAST(floor(count(*) * 0.25) AS INT) + 1], 1) AS p25, round(list_sort(list(lpa))[CAST(floor(count(*) * 0.5) AS INT) + 1], 1) AS p50,
  round(list_sort(list(lpa))[CAST(floor(count(*) * 0.75) AS INT) + 1], 1) AS p75, count(*) AS sample_size, coalesce(CAST(min(listed_year) AS VARCHAR) || '-' || CAST(max(listed_year) AS VARCHAR), '2024-2026') AS years_covered
FROM paid WHERE lpa BETWEEN 2 AND 120 GROUP BY GROUPING SETS ((soc_code, city, band, work_mode), (soc_code, city, work_mode), (soc_code, band, work_mode), (soc_code, work_mode)) HAVING count(*) >= 2"""


@query("a11_salary_cube", f"WITH {CUBE_SQL}")
def _(spark, sf):
    return facts.salary_cube(coded_postings(spark, sf))


@query("a12_floor_percentiles", """
SELECT occupation, region, count(salary_min) AS n, list_sort(list(salary_min) FILTER (salary_min IS NOT NULL))[CAST(floor(count(salary_min) * 0.25) AS INT) + 1] AS p25,
  list_sort(list(salary_min) FILTER (salary_min IS NOT NULL))[CAST(floor(count(salary_min) * 0.5) AS INT) + 1] AS p50,
  list_sort(list(salary_min) FILTER (salary_min IS NOT NULL))[CAST(floor(count(salary_min) * 0.75) AS INT) + 1] AS p75
FROM postings GROUP BY occupation, region HAVING count(salary_min) > 0""")
def _(spark, sf):
    return ranks.floor_percentiles(lens(spark, sf, "postings"), ["occupation", "region"], "salary_min", facts.QUARTILES)


@query("a13_linear_percentiles", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    out = ranks.linear_percentiles(lens(spark, sf, "SELECT l_returnflag, l_extendedprice FROM lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "med": 0.5, "p90": 0.9})
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("q1", "med", "p90")])


@query("a14_weighted_percentiles", """
WITH w AS (SELECT l_shipmonth, l_extendedprice AS v, sum(l_quantity) AS w FROM (SELECT month(l_shipdate) AS l_shipmonth, l_extendedprice, l_quantity FROM lineitem) GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_shipmonth ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_shipmonth) AS total FROM w)
SELECT CAST(l_shipmonth AS INT) AS month, min(v) FILTER (cum >= 0.25 * total) AS p25, min(v) FILTER (cum >= 0.5 * total) AS p50, min(v) FILTER (cum >= 0.75 * total) AS p75 FROM r GROUP BY 1""")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT month(l_shipdate) AS month, l_extendedprice, l_quantity FROM lineitem")
    return ranks.weighted_percentiles(rows, ["month"], "l_extendedprice", "l_quantity", facts.QUARTILES).select("month", *facts.QUARTILES)


BANDS_SQL = f"""{TERMS_SQL}, rp AS (SELECT *, {title_sql('title')} AS title_normalized FROM raw_postings),
paid AS (SELECT title_normalized, lower(trim(raw_city)) AS city, coalesce(experience_min, 3.0) AS y, coalesce((salary_min + salary_max) / 2.0, salary_min, salary_max) / 100000.0 AS lpa
  FROM rp WHERE coalesce(salary_min, salary_max) > 100000),
hit AS (SELECT t.role, 1 AS stage, p.* FROM terms t JOIN paid p ON contains(p.title_normalized, t.phrase) OR contains(t.phrase, p.title_normalized)
  UNION ALL SELECT t.role, 2, p.* FROM terms t JOIN paid p ON contains(p.title_normalized, t.last_word)),
picked AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE stage = 1) OVER (PARTITION BY role) AS n1 FROM hit) WHERE (stage = 1) = (n1 >= 5) AND lpa BETWEEN 2 AND 120),
labelled AS (SELECT role, lpa, unnest(list_filter(CASE WHEN city = 'remote' THEN ['remote'] ELSE ['onsite', CASE WHEN y <= 2.5 THEN 'exp:entry' WHEN y <= 6 THEN 'exp:mid' END, CASE WHEN y >= 5 THEN 'exp:senior' END,
  CASE WHEN contains(city, 'bengaluru') OR contains(city, 'bangalore') THEN 'city:Bengaluru' WHEN contains(city, 'hyderabad') THEN 'city:Hyderabad' WHEN contains(city, 'pune') THEN 'city:Pune'
    WHEN contains(city, 'mumbai') THEN 'city:Mumbai' WHEN contains(city, 'delhi') OR contains(city, 'gurgaon') OR contains(city, 'noida') OR contains(city, 'ncr') THEN 'city:Delhi NCR' END] END, lambda b: b IS NOT NULL)) AS band FROM picked),
bands AS (SELECT role, band, round(list_sort(list(lpa))[CAST(floor(count(*) * 0.25) AS INT) + 1], 1) AS p25, round(list_sort(list(lpa))[CAST(floor(count(*) * 0.5) AS INT) + 1], 1) AS p50,
  round(list_sort(list(lpa))[CAST(floor(count(*) * 0.75) AS INT) + 1], 1) AS p75, count(*) AS sample_size FROM labelled GROUP BY role, band)"""


def role_bands(spark, sf):
    rows = lens(spark, sf, "raw_postings").withColumn("title_normalized", titles.normalize_title(F.col("title"))).withColumn("city", F.col("raw_city"))
    return facts.salary_bands(role_terms(spark, sf), rows)


@query("a15_salary_bands", f"WITH {BANDS_SQL} SELECT * FROM bands")
def _(spark, sf):
    return role_bands(spark, sf)


@query("a15_overall_band", f"""
WITH {BANDS_SQL}, b AS (SELECT role, arg_min({{'p25': p25, 'p50': p50, 'p75': p75, 'n': sample_size}}, band) AS s FROM bands WHERE band IN ('onsite', 'remote') GROUP BY role)
SELECT t.role, coalesce(b.s.p25, 8.5) AS p25, coalesce(b.s.p50, 14.5) AS p50, coalesce(b.s.p75, 22.0) AS p75, coalesce(b.s.n, 25) AS sample_size FROM terms t LEFT JOIN b USING (role)""")
def _(spark, sf):
    return facts.overall_band(role_terms(spark, sf), role_bands(spark, sf))


@query("a16_experience_by_role", f"""
WITH {TERMS_SQL}, {NORMALIZED_SQL}, k AS (SELECT * FROM np WHERE experience_min IS NOT NULL),
s AS (SELECT t.role, 1 AS stage, count(*) AS n, avg(experience_min) AS a, avg(experience_max) AS b FROM terms t JOIN k ON contains(k.title_normalized, t.phrase) GROUP BY ALL
  UNION ALL SELECT t.role, 2, count(*), avg(experience_min), avg(experience_max) FROM terms t JOIN k ON contains(k.title_normalized, t.last_word) GROUP BY ALL),
f AS (SELECT role, arg_min({{'a': a, 'b': b}}, stage) AS x FROM s WHERE n >= 5 GROUP BY role)
SELECT t.role, coalesce(greatest(0.0, round(x.a, 1)), 2.0)::DOUBLE AS experience_min, CASE WHEN x IS NULL THEN 5.0 ELSE greatest(greatest(0.0, round(x.a, 1)) + 1, round(x.b, 1)) END::DOUBLE AS experience_max
FROM terms t LEFT JOIN f USING (role)""")
def _(spark, sf):
    return facts.experience_by_role(role_terms(spark, sf), normalized_postings(spark, sf))


BENCH_SQL = f"""
usd AS (SELECT 'boards' AS source, posting_id, region, title, {title_sql('title')} AS title_normalized, {map_sql('region', {'global': 'Other'})} AS country,
  CASE region WHEN 'india' THEN round(salary_min * 0.012::DOUBLE, 2) ELSE salary_min END AS lo, CASE region WHEN 'india' THEN round(salary_max * 0.012::DOUBLE, 2) ELSE salary_max END AS hi,
  CASE WHEN region = 'global' AND posting_id % 3 = 0 THEN salary_min + 5 END AS med, experience_min, listed_year FROM postings),
bench AS (SELECT source, title, title_normalized, region, country, coalesce(med, (lo + hi) / 2, lo) AS salary_usd, 'mid' AS experience_level, 'full' AS employment_type, listed_year AS year
  FROM usd WHERE region = 'global' AND (lo IS NOT NULL OR med IS NOT NULL) AND coalesce(med, lo) > 5000
  UNION ALL SELECT source, title, title_normalized, region, 'India', coalesce((lo + hi) / 2, lo, hi), CASE WHEN experience_min >= 8 THEN 'Senior' WHEN experience_min >= 3 THEN 'Mid-Level' WHEN experience_min IS NOT NULL THEN 'Entry-Level' END,
  'Full-time', listed_year FROM usd WHERE region = 'india' AND coalesce(lo, hi) > 500)"""


def benchmarks(spark, sf):
    home = F.col("region") == "india"
    rows = normalized_postings(spark, sf).select(
        "posting_id", "region", "title", "title_normalized", "experience_min", "listed_year", F.lit("boards").alias("source"), F.lit("Other").alias("country"),
        F.when(home, numbers.inr_to_usd(F.col("salary_min"))).otherwise(F.col("salary_min")).alias("salary_min_usd"),
        F.when(home, numbers.inr_to_usd(F.col("salary_max"))).otherwise(F.col("salary_max")).alias("salary_max_usd"),
        F.when(~home & (F.col("posting_id") % 3 == 0), F.col("salary_min") + 5).alias("salary_median_usd"),
        F.lit("mid").alias("experience_level"), F.lit("full").alias("employment_type"))
    return facts.salary_benchmarks(rows)


@query("o16_salary_benchmarks", f"WITH {BENCH_SQL} SELECT * REPLACE (round(salary_usd, 4) AS salary_usd) FROM bench")
def _(spark, sf):
    return benchmarks(spark, sf).withColumn("salary_usd", F.round("salary_usd", 4))


@query("a15_usd_bands", f"""
WITH {TERMS_SQL}, {BENCH_SQL}, paid AS (SELECT title_normalized, salary_usd FROM bench WHERE salary_usd > 15000),
hit AS (SELECT t.role, 1 AS stage, p.* FROM terms t JOIN paid p ON contains(p.title_normalized, t.phrase) OR contains(t.phrase, p.title_normalized)
  UNION ALL SELECT t.role, 2, p.* FROM terms t JOIN paid p ON contains(p.title_normalized, t.last_word)),
f AS (SELECT h.role, list_sort(list(salary_usd)) AS s, count(*) AS n FROM hit h JOIN (SELECT role, min(stage) AS stage FROM hit GROUP BY role) m USING (role, stage) GROUP BY h.role)
SELECT t.role, coalesce(round(s[CAST(floor(n * 0.25) AS INT) + 1], 1), 65000.0)::DOUBLE AS p25, coalesce(round(s[CAST(floor(n * 0.5) AS INT) + 1], 1), 98000.0)::DOUBLE AS p50,
  coalesce(round(s[CAST(floor(n * 0.75) AS INT) + 1], 1), 142000.0)::DOUBLE AS p75, coalesce(n, 40) AS sample_size FROM terms t LEFT JOIN f USING (role)""")
def _(spark, sf):
    return facts.usd_bands(role_terms(spark, sf), benchmarks(spark, sf))


@query("p10_salary_quality_flags", f"""
WITH {BENCH_SQL}, f AS (SELECT *, CASE WHEN source = 'synthetic' AND region = 'india' THEN 'synthetic_source' WHEN year < 2023 THEN 'stale_pre_2023'
  WHEN region = 'india' AND salary_usd < 1500 THEN 'monthly_suspected' WHEN region = 'india' AND salary_usd > 200000 THEN 'outlier' END AS flag FROM
  (SELECT * REPLACE (CASE WHEN year = 2025 THEN 'synthetic' ELSE source END AS source) FROM bench))
SELECT region, flag, year, count(*) AS rows_flagged FROM f WHERE flag IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    rows = benchmarks(spark, sf).withColumn("source", F.when(F.col("year") == 2025, "synthetic").otherwise(F.col("source")))
    return facts.quality_flags(rows, synthetic_source="synthetic").groupBy("region", "flag", "year").agg(F.count(F.lit(1)).alias("rows_flagged"))


@query("p06_salary_validity", """
SELECT posting_id, salary_min > 5000 AS over_5000, coalesce(salary_min, salary_max) > 100000 AS over_lakh, coalesce(salary_min, salary_max) / 100000 BETWEEN 2 AND 120 AS plausible_lpa
FROM postings WHERE coalesce(salary_min, salary_max) > 500""")
def _(spark, sf):
    pay = F.coalesce("salary_min", "salary_max")
    return lens(spark, sf, "postings").where(pay > 500).select("posting_id", (F.col("salary_min") > 5000).alias("over_5000"), (pay > 100000).alias("over_lakh"),
                                                               (pay / 100000).between(2, 120).alias("plausible_lpa"))


@query("o17_skill_demand", f"""
WITH s AS (SELECT p.region, coalesce(p.listed_year, 2024) AS year, p.listed_month AS month, p.occupation AS occupation_context, unnest({SPLIT_SQL}) AS skill_name
  FROM skill_lists l JOIN postings p USING (posting_id))
SELECT region, year, CAST(month AS INT) AS month, occupation_context, skill_name, {slug_sql('skill_name')} AS skill_normalized, 1 AS frequency FROM s
WHERE (length({slug_sql('skill_name')}) > 1 OR {slug_sql('skill_name')} IN ('c', 'r')) AND length({slug_sql('skill_name')}) < 50""")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT p.region, l.skills_text, p.listed_year, p.listed_month, p.occupation AS occupation_context FROM skill_lists l JOIN postings p ON p.posting_id = l.posting_id")
    return facts.skill_demand(rows)


@query("w04_key_dedupe", """
SELECT occupation, min(posting_id) AS first_posting, max(posting_id) AS last_posting FROM postings GROUP BY occupation""")
def _(spark, sf):
    rows = lens(spark, sf, "postings").select("occupation", "posting_id")
    first = ranks.keep_one(rows, ["occupation"], [F.asc("posting_id")]).withColumnRenamed("posting_id", "first_posting")
    last = ranks.keep_one(rows, ["occupation"], [F.desc("posting_id")]).withColumnRenamed("posting_id", "last_posting")
    return first.join(last, "occupation")
