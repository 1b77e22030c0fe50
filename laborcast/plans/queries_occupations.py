"""Occupation analytics over the part, posting and skill lenses."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.titles import major_group
from ..operators import facts, occupations as occ, ranks
from .catalog import decimal_round, query
from .lenses import lens
from .queries_facts import GENERIC_SQL, TERMS_SQL, VOLUMES_SQL, _WORDS, role_terms
from .queries_scalars import GROUP_SQL


def contains_count(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


SCORED_SQL = f"""
k AS (SELECT *, {contains_count('lower(task_description)', occ.AUTOMATION_WORDS)} AS a, {contains_count('lower(task_description)', occ.AUGMENTATION_WORDS)} AS g,
  {contains_count('lower(task_description)', occ.HUMAN_WORDS)} AS h FROM tasks),
scored AS (SELECT soc_code, load_id, task_id, task_description,
  round(CASE WHEN h > 0 AND h >= a AND h >= g THEN greatest(0.08::DOUBLE, least(0.25::DOUBLE - h * 0.04::DOUBLE, 0.35::DOUBLE)) WHEN a > g THEN least(0.75::DOUBLE + a * 0.06::DOUBLE, 0.96::DOUBLE)
    WHEN g >= a AND g > 0 THEN least(0.40::DOUBLE + g * 0.06::DOUBLE, 0.75::DOUBLE) WHEN h > 0 THEN greatest(0.10::DOUBLE, 0.28::DOUBLE - h * 0.04::DOUBLE) ELSE 0.30::DOUBLE END, 2) AS ai_impact_score,
  CASE WHEN h > 0 AND h >= a AND h >= g THEN '{occ.HUMAN}' WHEN a > g THEN '{occ.AUTOMATION}' WHEN g >= a AND g > 0 THEN '{occ.AUGMENTATION}' WHEN h > 0 THEN '{occ.HUMAN}' ELSE '{occ.MODERATE}' END AS transformation_type FROM k)"""


def scored_tasks(spark, sf):
    return occ.task_exposure(lens(spark, sf, "tasks"))


@query("o02_task_exposure", f"WITH {SCORED_SQL} SELECT task_id, ai_impact_score, transformation_type FROM scored")
def _(spark, sf):
    return scored_tasks(spark, sf).select("task_id", "ai_impact_score", "transformation_type")


EXPOSURE_SQL = f"""{SCORED_SQL},
exposure AS (SELECT soc_code, count(*) AS task_count, avg(ai_impact_score) AS mean_exposure, count(*) FILTER (transformation_type = '{occ.AUTOMATION}') AS automated,
  count(*) FILTER (transformation_type = '{occ.AUGMENTATION}') AS augmented, count(*) FILTER (transformation_type = '{occ.HUMAN}') AS human_centric,
  count(*) FILTER (transformation_type = '{occ.MODERATE}') AS moderate FROM scored GROUP BY soc_code),
occ_all AS (SELECT soc_code, title FROM occupations UNION ALL SELECT concat('00-000', length(t), '.00'), t FROM (SELECT unnest(['pipe welder', 'town teller', 'press officer']) AS t)),
occ_flag AS (SELECT o.*, regexp_matches(lower(title), '{"|".join(occ.TRADE_TITLES)}') AS trade, regexp_matches(lower(title), '{"|".join(occ.CLINICAL_TITLES)}') AS clinical,
  regexp_matches(lower(title), '{"|".join(occ.CLERICAL_TITLES)}') AS clerical FROM occ_all o),
occ_score AS (SELECT f.soc_code, f.title, CASE WHEN e.task_count IS NULL THEN CASE WHEN trade OR clinical THEN 0.16 WHEN clerical THEN 0.84 ELSE 0.40 END
  ELSE greatest(0.08, least(round(CASE WHEN trade THEN least(mean_exposure * 0.55::DOUBLE, 0.22) WHEN clinical THEN least(mean_exposure * 0.58::DOUBLE, 0.25) WHEN clerical THEN greatest(mean_exposure * 1.35::DOUBLE, 0.82) ELSE mean_exposure END, 2), 0.95)) END::DOUBLE AS ai_exposure_score,
  coalesce(task_count, 0) AS task_count, coalesce(automated, 0) AS automated, coalesce(augmented, 0) AS augmented, coalesce(human_centric, 0) AS human_centric, coalesce(moderate, 0) AS moderate
  FROM occ_flag f LEFT JOIN exposure e USING (soc_code)),
occ_exposure AS (SELECT *, CASE WHEN ai_exposure_score < 0.35 THEN 'Low' WHEN ai_exposure_score <= 0.65 THEN 'Moderate' ELSE 'High' END || ' transformation exposure' AS exposure_category FROM occ_score)"""


def all_occupations(spark, sf):
    """Occupations plus three without tasks, so that the title defaults occur."""
    extra = spark.createDataFrame([("00-00011.00", "pipe welder"), ("00-00011.00", "town teller"), ("00-00013.00", "press officer")], "soc_code string, title string")
    return lens(spark, sf, "occupations").select("soc_code", "title").unionByName(extra)


def exposures(spark, sf):
    return occ.occupation_exposure(all_occupations(spark, sf), occ.exposure_by_code(scored_tasks(spark, sf)))


@query("a17_exposure_by_code", f"WITH {EXPOSURE_SQL} SELECT * REPLACE (round(mean_exposure, 4) AS mean_exposure) FROM exposure")
def _(spark, sf):
    return occ.exposure_by_code(scored_tasks(spark, sf)).withColumn("mean_exposure", F.round("mean_exposure", 4))


@query("o03_occupation_exposure", f"WITH {EXPOSURE_SQL} SELECT * FROM occ_exposure")
def _(spark, sf):
    return exposures(spark, sf)


@query("t15_sample_tasks", f"""
WITH {SCORED_SQL} SELECT soc_code, task_id, ai_impact_score, i AS position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY soc_code ORDER BY load_id) AS INT) AS i FROM scored) WHERE i <= 5""")
def _(spark, sf):
    return occ.sample_tasks(scored_tasks(spark, sf), "load_id").select("soc_code", "task_id", "ai_impact_score", "position")


@query("p17_tasks_in_order", "SELECT soc_code, task_id, CAST(row_number() OVER (PARTITION BY soc_code ORDER BY load_id) AS INT) AS position FROM tasks")
def _(spark, sf):
    # Only the numbering of each task within its occupation is materialised; a reader sorts by it.
    numbered = ranks.dense_rank_positions(lens(spark, sf, "tasks").withColumn("_order", -F.col("load_id")), ["soc_code"], "_order", [], "position")
    return numbered.select("soc_code", "task_id", F.col("position").cast("int").alias("position"))


HISTORY_SQL = f"""{VOLUMES_SQL},
vol AS (SELECT pattern, region, count(*) AS total, count(DISTINCT company) AS companies, avg((salary_min + salary_max) / 2) AS avg_mid, avg(salary_min) AS avg_min, avg(salary_max) AS avg_max,
  count(*) FILTER (listed_year = 2024) AS y2024, count(*) FILTER (listed_year >= 2025) AS y2025, count(*) FILTER (listed_year >= 2024) AS modern FROM matched GROUP BY pattern, region),
pc AS (SELECT pattern, region, nationkey, count(*) AS cnt FROM matched GROUP BY ALL),
pl AS (SELECT pattern, region, list(concat('NATION_', CAST(nationkey AS VARCHAR), ' (', CAST(cnt AS VARCHAR), ')') ORDER BY i) AS places FROM (SELECT *, row_number() OVER (PARTITION BY pattern, region ORDER BY cnt DESC, concat('NATION_', CAST(nationkey AS VARCHAR))) AS i FROM pc) WHERE i <= 5 GROUP BY ALL),
hist AS (SELECT t.soc_code, t.role AS title, t.pattern, coalesce(g.total, 0) AS g_total, coalesce(g.companies, 0) AS g_companies, g.avg_mid AS g_avg, coalesce(g.y2024, 0) AS g_2024, coalesce(g.y2025, 0) AS g_2025,
  coalesce(i.total, 0) AS i_total, coalesce(i.companies, 0) AS i_companies, coalesce(i.modern, 0) AS i_modern, coalesce(i.avg_max, i.avg_min) AS i_pay, coalesce(pg.places, []) AS g_places, coalesce(pi.places, []) AS i_places
  FROM terms t LEFT JOIN vol g ON g.pattern = t.pattern AND g.region = 'global' LEFT JOIN vol i ON i.pattern = t.pattern AND i.region = 'india'
  LEFT JOIN pl pg ON pg.pattern = t.pattern AND pg.region = 'global' LEFT JOIN pl pi ON pi.pattern = t.pattern AND pi.region = 'india')"""


def demand_sql(name: str, vol: str, most: float) -> str:
    vol = f"({vol})"
    return f"""{name} AS (SELECT *, round(v1, 2) AS volume_score, round(v2, 2) AS employer_diversification, round(v3, 2) AS velocity_ratio,
  greatest(0.10, least({decimal_round('v1 * 0.40::DOUBLE + v2 * 0.25::DOUBLE + v3 * 0.20::DOUBLE + v4 * 0.15::DOUBLE', 2)}, 0.98)) AS current_demand_score FROM (
  SELECT *, {vol} AS total_postings, g_companies + i_companies AS unique_employers, CASE WHEN {vol} > 0 THEN least(ln(1 + {vol}) / ln(1 + {most}::DOUBLE), 1.0) ELSE 0.15 END AS v1,
    CASE WHEN {vol} > 0 THEN least((g_companies + i_companies) / ({vol} * 0.4::DOUBLE + 1), 1.0) ELSE 0.5 END AS v2,
    CASE WHEN {vol} > 0 THEN least((i_modern + g_2024 + g_2025) / ({vol}) * 1.2::DOUBLE, 1.0) ELSE 0.5 END AS v3, least((len(i_places) + len(g_places)) / 8.0, 1.0)::DOUBLE AS v4 FROM hist))"""


def history(spark, sf):
    terms = role_terms(spark, sf)
    matched = facts.matched_postings(terms, "pattern", lens(spark, sf, "postings"))
    return occ.history_by_occupation(terms, facts.posting_volumes(matched, "pattern"), facts.top_places(matched, "pattern"))


@query("o01_demand_score", f"""
WITH {HISTORY_SQL}, {demand_sql('d1', 'g_total + i_total', 15000.0)}, {demand_sql('d2', 'i_total', 5000.0)}, {demand_sql('d3', 'g_total', 10000.0)}
SELECT 'all' AS scope, title, current_demand_score, volume_score, employer_diversification, velocity_ratio, total_postings, unique_employers FROM d1
UNION ALL SELECT 'india', title, current_demand_score, volume_score, employer_diversification, velocity_ratio, total_postings, unique_employers FROM d2
UNION ALL SELECT 'global', title, current_demand_score, volume_score, employer_diversification, velocity_ratio, total_postings, unique_employers FROM d3""")
def _(spark, sf):
    base = history(spark, sf)
    cols = ["title", "current_demand_score", "volume_score", "employer_diversification", "velocity_ratio", "total_postings", "unique_employers"]
    parts = [occ.demand_scores(base, region=r).select(F.lit(r).alias("scope"), *cols) for r in ("all", "india", "global")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GROWTH_EXPR = decimal_round("""current_demand_score * 0.70::DOUBLE + CASE WHEN ai_exposure_score >= 0.65::DOUBLE THEN -(ai_exposure_score - 0.50::DOUBLE) * 0.85::DOUBLE
    WHEN ai_exposure_score <= 0.30::DOUBLE THEN (0.30::DOUBLE - ai_exposure_score) * 0.20::DOUBLE ELSE (0.50::DOUBLE - ai_exposure_score) * 0.25::DOUBLE END
    + least((i_modern + g_2024 + g_2025) / greatest(g_total + i_total, 1), 1.0) * 0.15::DOUBLE""", 2)
CONFIDENCE_EXPR = decimal_round("""CASE WHEN g_total + i_total > 0 THEN least((g_total + i_total) / 800.0, 0.45) ELSE 0.10 END::DOUBLE + CASE WHEN task_count > 0 THEN 0.30 ELSE 0.10 END::DOUBLE
    + CASE WHEN g_total > 0 AND i_total > 0 THEN 0.15 ELSE 0.05 END::DOUBLE + 0.10::DOUBLE""", 2)
GROWTH_SQL = f"""{HISTORY_SQL}, {demand_sql('d1', 'g_total + i_total', 15000.0)}, {EXPOSURE_SQL},
gr AS (SELECT d.*, e.* EXCLUDE (soc_code, title), greatest(0.10, least({GROWTH_EXPR}, 0.98)) AS growth_score,
  least({CONFIDENCE_EXPR}, 0.95) AS confidence_score FROM d1 d JOIN occ_exposure e USING (soc_code)),
outlook AS (SELECT *, CASE WHEN growth_score >= 0.75 AND confidence_score >= 0.55 THEN 'Strong Growth' WHEN growth_score >= 0.55 THEN 'Moderate Growth'
  WHEN growth_score <= 0.35 OR (growth_score <= 0.45 AND ai_exposure_score >= 0.65) THEN 'Declining Demand' WHEN ai_exposure_score >= 0.65 THEN 'Transforming (High AI Exposure)'
  WHEN growth_score >= 0.40 THEN 'Stable Demand' ELSE 'Emerging / Evolving' END AS outlook FROM gr)"""


def forecasts(spark, sf):
    joined = occ.demand_scores(history(spark, sf)).join(exposures(spark, sf).drop("title"), "soc_code")
    return occ.growth(joined)


@query("o04_growth_score", f"WITH {GROWTH_SQL} SELECT title, growth_score FROM outlook")
def _(spark, sf):
    return forecasts(spark, sf).select("title", "growth_score")


@query("o05_confidence", f"WITH {GROWTH_SQL} SELECT title, confidence_score FROM outlook")
def _(spark, sf):
    return forecasts(spark, sf).select("title", "confidence_score")


@query("o06_outlook", f"WITH {GROWTH_SQL} SELECT title, outlook FROM outlook")
def _(spark, sf):
    return forecasts(spark, sf).select("title", "outlook")


@query("o07_trajectory", f"""
WITH RECURSIVE {GROWTH_SQL}, b AS (SELECT soc_code, title, (growth_score - 0.5::DOUBLE) * 0.25::DOUBLE AS r, current_demand_score AS d, confidence_score AS c FROM outlook),
h AS (SELECT soc_code, title, y, r, c, round(CASE y WHEN 2021 THEN CASE WHEN r < 0 THEN 1.18::DOUBLE + d * 0.08::DOUBLE ELSE 0.65::DOUBLE + d * 0.15::DOUBLE END * 100
    WHEN 2022 THEN CASE WHEN r < 0 THEN 1.12::DOUBLE + d * 0.06::DOUBLE ELSE 0.76::DOUBLE + d * 0.14::DOUBLE END * 100 WHEN 2023 THEN CASE WHEN r < 0 THEN 1.06::DOUBLE + d * 0.03::DOUBLE ELSE 0.88::DOUBLE + d * 0.12::DOUBLE END * 100
    WHEN 2024 THEN 100.0::DOUBLE WHEN 2025 THEN 100 * (1 + r * 0.9::DOUBLE) ELSE 100 * (1 + r * 1.8::DOUBLE) END, 1) AS g,
  round(CASE y WHEN 2021 THEN CASE WHEN r < 0 THEN 1.18::DOUBLE + d * 0.08::DOUBLE ELSE 0.65::DOUBLE + d * 0.15::DOUBLE END * 96
    WHEN 2022 THEN CASE WHEN r < 0 THEN 1.12::DOUBLE + d * 0.06::DOUBLE ELSE 0.76::DOUBLE + d * 0.14::DOUBLE END * 96 WHEN 2023 THEN CASE WHEN r < 0 THEN 1.06::DOUBLE + d * 0.03::DOUBLE ELSE 0.88::DOUBLE + d * 0.12::DOUBLE END * 96
    ELSE 100 * (1 + (y - 2024) * (r * 1.15::DOUBLE) * 0.95::DOUBLE) END, 1) AS i FROM b, (SELECT CAST(unnest(range(2021, 2027)) AS INT) AS y)),
f AS (SELECT soc_code, title, y, r, c, greatest(10.0, g)::DOUBLE AS g, greatest(10.0, i)::DOUBLE AS i, 1.0::DOUBLE AS damp FROM h WHERE y = 2026
  UNION ALL SELECT soc_code, title, y + 1, r, c, g * (1 + r * (damp * 0.9::DOUBLE)), i * (1 + (r * 1.15::DOUBLE) * (damp * 0.9::DOUBLE)), damp * 0.9::DOUBLE FROM f WHERE y < 2031)
SELECT soc_code, title, y AS year, 'historical' AS status, round(greatest(10.0, i), 1)::DOUBLE AS india_index, round(greatest(10.0, g), 1)::DOUBLE AS global_index,
  round(greatest(8.0, i * 0.96::DOUBLE), 3) AS india_lower_bound, round(i * 1.04::DOUBLE, 3) AS india_upper_bound, round(greatest(8.0, g * 0.97::DOUBLE), 3) AS global_lower_bound, round(g * 1.03::DOUBLE, 3) AS global_upper_bound FROM h
UNION ALL SELECT soc_code, title, y, 'forecast', round(i, 1), round(g, 1), greatest(10.0, round(i - (1 - c) * 14 * sqrt(y - 2026) * 1.1::DOUBLE, 1)), round(i + (1 - c) * 14 * sqrt(y - 2026) * 1.1::DOUBLE, 1),
  greatest(10.0, round(g - (1 - c) * 14 * sqrt(y - 2026), 1)), round(g + (1 - c) * 14 * sqrt(y - 2026), 1) FROM f WHERE y > 2026""")
def _(spark, sf):
    out = occ.trajectory(forecasts(spark, sf))
    return out.select("soc_code", "title", "year", "status", "india_index", "global_index", *[
        F.round(c, 3).alias(c) for c in ("india_lower_bound", "india_upper_bound", "global_lower_bound", "global_upper_bound")])


@query("w12_damped_index", """
WITH RECURSIVE b AS (SELECT p_partkey, p_retailprice AS start, (p_size - 25) / 100.0::DOUBLE AS r, 1 + p_partkey % 6 AS steps FROM part),
f AS (SELECT p_partkey, start AS v, r, steps, 0 AS k, 1.0::DOUBLE AS d FROM b UNION ALL SELECT p_partkey, v * (1 + r * (d * 0.9::DOUBLE)), r, steps, k + 1, d * 0.9::DOUBLE FROM f WHERE k < steps)
SELECT p_partkey, round(v, 4) AS index_value FROM f WHERE k = steps""")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT p_partkey, p_retailprice, p_size FROM part")
    value = occ.damped_index(F.col("p_retailprice"), (F.col("p_size") - 25) / 100.0, 1 + F.col("p_partkey") % 6)
    return rows.select("p_partkey", F.round(value, 4).alias("index_value"))


@query("o08_composite_ranking", f"""
WITH {GROWTH_SQL}, c AS (SELECT title, round(current_demand_score * 0.5::DOUBLE + growth_score * 0.1875::DOUBLE + greatest(0.0, 1 - ai_exposure_score * 0.7::DOUBLE) * 0.125::DOUBLE + current_demand_score * 0.9::DOUBLE * 0.0625::DOUBLE + confidence_score * 0.125::DOUBLE, 3) AS composite_score FROM outlook)
SELECT title, composite_score, row_number() OVER (ORDER BY composite_score DESC, title) AS rank FROM c""")
def _(spark, sf):
    weights = {"current_demand": 0.8, "confidence": 0.2, "unknown": 9.0}
    ranked = occ.rank_careers(forecasts(spark, sf).withColumn("request", F.lit(1)), ["request"], weights=weights)
    return ranked.select("title", "composite_score", "rank")


@query("w03_rank_positions", """
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    return ranks.dense_rank_positions(rows, ["o_orderstatus"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "rank")


TOP_SQL = f"""
mention_role AS (SELECT occupation_context AS title, region, skill_normalized, CAST(sum(frequency) AS BIGINT) AS freq FROM skill_mentions GROUP BY ALL),
mr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, region ORDER BY freq DESC, skill_normalized) AS p FROM mention_role) WHERE p <= 40 AND skill_normalized NOT IN ({GENERIC_SQL})),
mt AS (SELECT *, row_number() OVER (PARTITION BY title, region ORDER BY freq DESC, skill_normalized) AS q FROM mr),
tops AS (SELECT title, list(skill_normalized ORDER BY o, q) AS top_skills FROM (SELECT title, skill_normalized, min(o) AS o, arg_min(q, o) AS q FROM (SELECT *, CASE region WHEN 'india' THEN 0 ELSE 1 END AS o FROM mt WHERE q <= 6) GROUP BY title, skill_normalized) GROUP BY title)"""


def top_skill_arrays(spark, sf):
    """Domestic then global top skills of each occupation, without repeats."""
    skills = facts.role_skills(role_terms(spark, sf), lens(spark, sf, "skill_mentions"), ["india", "global"], limit=6)
    lists = skills.groupBy("role").pivot("region", ["india", "global"]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "skill_normalized"))), lambda x: x["skill_normalized"]))
    empty = F.array().cast("array<string>")
    return lists.select(F.col("role").alias("title"), F.array_distinct(F.concat(F.coalesce("india", empty), F.coalesce("global", empty))).alias("top_skills"))


@query("u04_ordered_skill_union", f"WITH {TOP_SQL} SELECT title, array_to_string(top_skills, ',') AS top_skills FROM tops")
def _(spark, sf):
    return top_skill_arrays(spark, sf).withColumn("top_skills", F.array_join("top_skills", ","))


DRIVERS_SQL = """list_filter([
  CASE WHEN total_postings > 500 THEN concat('Substantial real-world market presence with ', format('{:,}', total_postings), ' verified postings across global and Indian labor markets.')
    WHEN total_postings > 50 THEN concat('Active recruitment signals with ', format('{:,}', total_postings), ' job postings tracked.') ELSE 'Emerging specialization with concentrated niche employer demand.' END,
  CASE WHEN velocity_ratio > 0.6 THEN 'Strong recent hiring momentum with steady acceleration from 2024 through 2026.' WHEN velocity_ratio > 0.3 THEN 'Consistent baseline posting velocity across consecutive hiring cycles.' END,
  CASE WHEN augmented > automated THEN concat('High augmentation leverage: ', augmented, ' tasks enhanced by generative AI tools, increasing worker productivity rather than substituting roles.')
    WHEN automated > 0 THEN concat('Routine task automation: ', automated, ' tasks exposed to workflow automation, shifting value toward strategic oversight.')
    ELSE concat('Task profile (', task_count, ' O*NET tasks) indicates resilient cognitive and domain-specific problem solving.') END,
  CASE WHEN len(i_places) > 0 AND len(g_places) > 0 THEN concat('Balanced multi-regional hiring spanning leading Indian tech hubs (', trim(split_part(i_places[1], '(', 1)), ') and international markets.')
    WHEN len(i_places) > 0 THEN concat('Strong domestic Indian market concentration, primarily across ', trim(split_part(i_places[1], '(', 1)), ' and surrounding tech centers.') END,
  CASE WHEN len(top_skills) > 0 THEN concat('High employer demand for foundational and emerging capabilities: ', array_to_string(top_skills[1:4], ', '), '.') END], lambda s: s IS NOT NULL)"""

ANALYSIS_SQL = f"{GROWTH_SQL}, {TOP_SQL}, analysis AS (SELECT o.*, coalesce(t.top_skills, []) AS top_skills FROM outlook o LEFT JOIN tops t USING (title))"


def analysis(spark, sf):
    return occ.career_analysis(history(spark, sf), exposures(spark, sf), top_skill_arrays(spark, sf))


@query("o09_evidence", f"WITH {ANALYSIS_SQL} SELECT title, array_to_string({DRIVERS_SQL}, ' | ') AS drivers FROM analysis")
def _(spark, sf):
    return analysis(spark, sf).select("title", F.array_join("drivers", " | ").alias("drivers"))


@query("o12_career_analysis", f"""
WITH {ANALYSIS_SQL} SELECT soc_code, title, current_demand_score, growth_score, ai_exposure_score, confidence_score, outlook, array_to_string(top_skills[1:6], ',') AS top_skills,
  array_to_string({DRIVERS_SQL}, ' | ') AS drivers, task_count AS tasks_analyzed FROM analysis""")
def _(spark, sf):
    return analysis(spark, sf).select(
        "soc_code", "title", "current_demand_score", "growth_score", "ai_exposure_score", "confidence_score", "outlook",
        F.array_join(F.slice("top_skills", 1, 6), ",").alias("top_skills"), F.array_join("drivers", " | ").alias("drivers"), F.col("task_count").alias("tasks_analyzed"))


@query("o11_regional_breakdown", f"""
WITH {HISTORY_SQL}, {demand_sql('d1', 'g_total + i_total', 15000.0)}
SELECT soc_code, title, 'india' AS region, i_total AS posting_volume, round(velocity_ratio * 15, 1) AS growth_proxy, round(i_pay / 100000, 1) AS median_salary_inr_lpa, round(i_pay * 0.012::DOUBLE, 2) AS median_salary_usd, array_to_string(i_places, ';') AS top_places FROM d1
UNION ALL SELECT soc_code, title, 'global', g_total, round(velocity_ratio * 18, 1), NULL, round(g_avg, 2), array_to_string(g_places, ';') FROM d1""")
def _(spark, sf):
    return occ.regional_breakdown(occ.demand_scores(history(spark, sf))).withColumn("top_places", F.array_join("top_places", ";"))


@query("o13_regional_report", """
WITH y AS (SELECT 'year' AS part, region, CAST(coalesce(listed_year, 2024) AS VARCHAR) AS item, count(*) AS amount FROM postings GROUP BY ALL),
s AS (SELECT 'skill' AS part, region, skill_normalized AS item, CAST(sum(frequency) AS BIGINT) AS amount FROM skill_mentions GROUP BY ALL)
SELECT * FROM y UNION ALL (SELECT * FROM s ORDER BY amount DESC, item, region LIMIT 25)""")
def _(spark, sf):
    years = facts.regional_years(lens(spark, sf, "postings")).select(F.lit("year").alias("part"), "region", F.col("year").cast("string").alias("item"), F.col("total_postings").alias("amount"))
    skills = facts.skill_comparison(lens(spark, sf, "skill_mentions")).orderBy(F.desc("total_demand"), "skill_normalized", "region").limit(25)
    return years.unionByName(skills.select(F.lit("skill").alias("part"), "region", F.col("skill_normalized").alias("item"), F.col("total_demand").alias("amount")))


@query("o14_domain_outlook", f"""
WITH {GROWTH_SQL} SELECT title, outlook, growth_score, round(least(CASE WHEN contains(title, 'engineer') THEN 3.0 ELSE 1.0 END * 0.35 + 0.5, 0.98), 2)::DOUBLE AS relevance_score
FROM outlook WHERE contains(title, 'engineer') OR contains(title, 'data') ORDER BY CASE WHEN contains(title, 'engineer') THEN 3 ELSE 1 END DESC, length(title), title LIMIT 12""")
def _(spark, sf):
    from ..operators.resolve import domain_search

    requests = spark.createDataFrame([(1, "Engineer data")], "request long, query string")
    found = domain_search(requests, lens(spark, sf, "SELECT soc_code, title, '' AS description FROM occupations"), k=12)
    return found.join(forecasts(spark, sf).select("title", "outlook", "growth_score"), "title").select("title", "outlook", "growth_score", "relevance_score")


GRAPH_SQL = f"""{SCORED_SQL},
dom AS (SELECT soc_code, title, {GROUP_SQL.replace('soc_code', 'soc_code')} FROM occupations),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY soc_code ORDER BY load_id) AS INT) AS position FROM scored),
sk AS (SELECT soc_code, concat('Element ', element) AS skill_name, max(importance) AS importance FROM rating_groups GROUP BY ALL),
sk2 AS (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY importance DESC, skill_name) AS position FROM sk),
te AS (SELECT soc_code, lower(p_brand) AS technology_name, max(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS hot_technology FROM parts_coded GROUP BY ALL),
te2 AS (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY hot_technology DESC, technology_name) AS position FROM te),
ms AS (SELECT soc_code, skill_normalized, count(*) AS n FROM skill_mentions GROUP BY ALL),
ms2 AS (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY n DESC, skill_normalized) AS position FROM ms),
tools AS (SELECT soc_code, technology_name, hot_technology FROM te2 WHERE position <= 6 UNION ALL SELECT soc_code, skill_normalized, 1 FROM ms2 WHERE position <= 5 AND soc_code NOT IN (SELECT soc_code FROM te)),
parts AS (SELECT soc_code, concat('dom_', replace(lower(career_cluster), ' ', '_')) AS id, 'domain' AS type, 0.85 AS w, 'BELONGS_TO_DOMAIN' AS rel, 1.0 AS ew FROM dom
  UNION ALL SELECT soc_code, concat('task_', position), 'task', ai_impact_score, 'EXECUTES_TASK', ai_impact_score FROM tk WHERE position <= 5
  UNION ALL SELECT soc_code, concat('skill_', replace(lower(skill_name), ' ', '_')), 'skill', round(importance / 100, 2), 'REQUIRES_COMPETENCY', round(importance / 100, 2) FROM sk2 WHERE position <= 6
  UNION ALL SELECT soc_code, concat('tech_', replace(lower(technology_name), ' ', '_')), 'technology', CASE WHEN hot_technology = 1 THEN 1.0 ELSE 0.65 END, 'UTILIZES_TOOL', CASE WHEN hot_technology = 1 THEN 0.9 ELSE 0.65 END FROM tools)"""


def graph(spark, sf):
    base = lens(spark, sf, "occupations").select("soc_code", "title", major_group(F.col("soc_code"))["career_cluster"].alias("domain"))
    skills = lens(spark, sf, "rating_groups").groupBy("soc_code", F.concat(F.lit("Element "), "element").alias("skill_name")).agg(F.max("importance").alias("importance"))
    tech = lens(spark, sf, "parts_coded").groupBy("soc_code", F.lower("p_brand").alias("technology_name")) \
        .agg(F.max((F.col("p_size") % 2 == 0).cast("int")).alias("hot_technology"))
    market = lens(spark, sf, "skill_mentions").groupBy("soc_code", "skill_normalized").agg(F.count(F.lit(1)).alias("n"))
    return occ.knowledge_graph(
        base, occ.sample_tasks(scored_tasks(spark, sf), "load_id"), ranks.top_k(skills, ["soc_code"], [F.desc("importance"), F.asc("skill_name")], 6),
        ranks.top_k(tech, ["soc_code"], [F.desc("hot_technology"), F.asc("technology_name")], 6), ranks.top_k(market, ["soc_code"], [F.desc("n"), F.asc("skill_normalized")], 5))


@query("o10_graph_nodes", f"""
WITH {GRAPH_SQL} SELECT soc_code, concat('occ_', soc_code) AS id, 'occupation' AS type, 1.0::DOUBLE AS weight FROM occupations UNION ALL SELECT soc_code, id, min(type), max(w)::DOUBLE FROM parts GROUP BY soc_code, id""")
def _(spark, sf):
    return graph(spark, sf)[0].select("soc_code", "id", "type", "weight")


@query("o10_graph_edges", f"WITH {GRAPH_SQL} SELECT soc_code, concat('occ_', soc_code) AS source, id AS target, rel AS relationship, ew::DOUBLE AS weight FROM parts")
def _(spark, sf):
    return graph(spark, sf)[1]
