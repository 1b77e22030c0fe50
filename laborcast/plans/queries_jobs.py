"""Matching, ranking and salary over jobs, candidates and applications."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places
from ..operators import best_matches as bm, enrichment as en, facts, matching as mt, postings as po, ranks, salary as sal, taxonomy as tax
from ..session import shared_folder
from .catalog import decimal_round, query
from .lenses import WORD_ALIASES, lens
from .queries_facts import BANDS_SQL, role_bands
from .queries_scalars import DUPLICATE_KEY_SQL, EXPAND_SQL, band_sql, city_sql
from .queries_text import LEVEL_SQL, aliases, profile_skills, skills
from ..functions.titles import POSTING_TITLE_BANDS

NOW = "2002-01-01 12:00:00"
BROAD_SQL = "(" + ", ".join(f"'{s}'" for s in mt.BROAD_SKILLS) + ")"


def now():
    return F.lit(NOW).cast("timestamp")


def fresh_now():
    return F.lit("2000-06-01 00:00:00").cast("timestamp")


def jobs(spark, sf):
    return lens(spark, sf, "jobs").withColumn("location", places.normalize_city(F.col("location_raw")))


def candidates(spark, sf):
    rows = lens(spark, sf, "candidates")
    return rows.select("candidate_id", F.col("experience_years").cast("double").alias("experience_years"), F.filter(F.array("education"), lambda e: e != "").alias("education"),
                       places.expand_city(F.col("location")).alias("cities"), F.col("target_role").alias("role"), places.normalize_city(F.col("location")).alias("city"))


def flag():
    return mt.is_broad(F.col("skill_id"))


PROFILE_SQL = """
cnt AS (SELECT role, skill_id, count(DISTINCT job_id) AS jobs FROM job_own_skills GROUP BY ALL), tot AS (SELECT role, count(DISTINCT job_id) AS jobs_analysed FROM job_own_skills GROUP BY role),
prof AS (SELECT c.role, c.skill_id, c.jobs, t.jobs_analysed, round(c.jobs / t.jobs_analysed, 3) AS share, row_number() OVER (PARTITION BY c.role ORDER BY c.jobs DESC, c.skill_id) AS position FROM cnt c JOIN tot t USING (role)),
profile AS (SELECT * FROM prof WHERE position <= 15)"""


def profile(spark, sf):
    return mt.market_profile(lens(spark, sf, "job_own_skills"), ["role"])


@query("a18_market_profile", f"WITH {PROFILE_SQL} SELECT role, skill_id, jobs, jobs_analysed, share FROM profile")
def _(spark, sf):
    return profile(spark, sf).select("role", "skill_id", "jobs", "jobs_analysed", "share")


INFER_SQL = f"""{PROFILE_SQL},
own AS (SELECT job_id, list(skill_id) AS own, count(*) AS n FROM job_own_skills GROUP BY job_id),
common AS (SELECT role, list(skill_id ORDER BY position) AS common FROM profile WHERE share >= 0.15 AND skill_id NOT IN {BROAD_SQL} GROUP BY role),
fill AS (SELECT j.job_id, j.role, unnest(list_filter(c.common, lambda s: NOT list_contains(coalesce(o.own, []), s))[1:5 - coalesce(o.n, 0)]) AS skill_id FROM jobs j JOIN common c USING (role) LEFT JOIN own o USING (job_id) WHERE coalesce(o.n, 0) < 3),
job_skills AS (SELECT job_id, role, skill_id, false AS inferred FROM job_own_skills UNION ALL SELECT job_id, role, skill_id, true FROM fill)"""


def job_skills(spark, sf):
    return mt.infer_skills(lens(spark, sf, "jobs"), lens(spark, sf, "job_own_skills"), profile(spark, sf), flag())


@query("m04_skill_inference", f"WITH {INFER_SQL} SELECT * FROM job_skills")
def _(spark, sf):
    return job_skills(spark, sf)


@query("m05_concrete_children")
def _(spark, sf):
    return mt.concrete_children(mt.market_profile(lens(spark, sf, "job_own_skills"), ["role"], k=None), tax.ancestors(skills(spark, sf)), ["role"], flag())


@query("m18_skills_confidence", f"WITH {INFER_SQL} SELECT job_id, CASE WHEN count(*) FILTER (inferred) = 0 THEN 'extracted' WHEN count(*) FILTER (inferred) = count(*) THEN 'inferred' ELSE 'partly_inferred' END AS skills_confidence FROM job_skills GROUP BY job_id")
def _(spark, sf):
    return mt.skills_confidence(job_skills(spark, sf))


CREDIT_SQL = f"""{INFER_SQL}, {LEVEL_SQL},
direct AS (SELECT candidate_id, skill_id, CASE level WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN needs_verification THEN 0.5 ELSE 1.0 END::DOUBLE AS credit FROM profile_skills),
via AS (SELECT d.candidate_id, s.maps_to AS skill_id, max(credit) AS credit FROM direct d JOIN skills s ON s.id = d.skill_id AND s.maps_to <> '' GROUP BY ALL),
sr AS (SELECT a.candidate_id, a.job_id, j.skill_id, j.inferred, (CASE WHEN j.inferred THEN 0.5 ELSE 1.0 END * CASE WHEN j.skill_id IN {BROAD_SQL} THEN 0.5 ELSE 1.0 END)::DOUBLE AS w, coalesce(nullif(d.credit, 0), nullif(v.credit, 0), 0.5 * pd.credit, 0) AS c
  FROM applications a JOIN job_skills j USING (job_id) LEFT JOIN skills s ON s.id = j.skill_id LEFT JOIN direct d ON d.candidate_id = a.candidate_id AND d.skill_id = j.skill_id LEFT JOIN via v ON v.candidate_id = a.candidate_id AND v.skill_id = j.skill_id
  LEFT JOIN direct pd ON pd.candidate_id = a.candidate_id AND pd.skill_id = s.maps_to),
top8 AS (SELECT candidate_id, list(skill_id ORDER BY level DESC, skill_id)[1:8] AS top FROM profile_skills GROUP BY candidate_id),
kw AS (SELECT a.candidate_id, a.job_id, CASE WHEN top IS NULL THEN 0.0 ELSE len(list_filter(top, lambda s: regexp_matches(lower(concat(coalesce(j.title, ''), chr(10), coalesce(j.description, ''))), '\\b' || regexp_escape(replace(s, '_', ' ')) || '\\b'))) / len(top) END::DOUBLE AS skills
  FROM applications a JOIN jobs j USING (job_id) LEFT JOIN top8 t USING (candidate_id) WHERE a.job_id NOT IN (SELECT job_id FROM job_skills)),
ss AS (SELECT candidate_id, job_id, sum(w * c) / sum(w) * (1 - 0.3::DOUBLE * avg(CASE WHEN inferred THEN 1.0 ELSE 0.0 END)) AS skills FROM sr GROUP BY ALL UNION ALL SELECT candidate_id, job_id, skills FROM kw)"""


def skill_rows(spark, sf, pairs):
    s = skills(spark, sf)
    return mt.skill_rows(pairs, job_skills(spark, sf), mt.skill_credits(profile_skills(spark, sf), s), s, flag(), known=mt.known_items(s))


def applications(spark, sf):
    return lens(spark, sf, "applications")


def sides(spark, sf):
    """The skill lists of the jobs and the credit maps of the candidates."""
    s = skills(spark, sf)
    return mt.job_lists(jobs(spark, sf), job_skills(spark, sf), s, flag()), mt.credit_maps(profile_skills(spark, sf), s)


def known(spark, sf):
    return mt.known_items(skills(spark, sf))


def pair_scores(spark, sf):
    return mt.pair_scores(applications(spark, sf), *sides(spark, sf), known=known(spark, sf))


@query("m06_skill_component", f"WITH {CREDIT_SQL} SELECT candidate_id, job_id, round(skills, 6) AS skills FROM ss")
def _(spark, sf):
    return pair_scores(spark, sf).select(*mt.PAIR, F.round("skills", 6).alias("skills"))


@query("j17_credited_job_skills", f"WITH {CREDIT_SQL} SELECT candidate_id, job_id, skill_id, w, round(c, 2) AS c FROM sr")
def _(spark, sf):
    return skill_rows(spark, sf, applications(spark, sf)).select(*mt.PAIR, "skill_id", "w", F.round("c", 2).alias("c"))


@query("m19_matched_and_missing", f"""
WITH {CREDIT_SQL} SELECT candidate_id, job_id, coalesce(string_agg(skill_id, ',' ORDER BY skill_id IN {BROAD_SQL}, inferred, skill_id) FILTER (c > 0), '') AS matched, coalesce(string_agg(skill_id, ',' ORDER BY skill_id IN {BROAD_SQL}, inferred, skill_id) FILTER (c <= 0), '') AS missing FROM sr GROUP BY ALL""")
def _(spark, sf):
    rows = pair_scores(spark, sf).where(~F.col("by_text"))
    return rows.select(*mt.PAIR, F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


@query("m07_keyword_fallback", f"""
WITH {LEVEL_SQL}, top8 AS (SELECT candidate_id, list(skill_id ORDER BY level DESC, skill_id)[1:8] AS top FROM profile_skills GROUP BY candidate_id)
SELECT a.candidate_id, a.job_id, CASE WHEN top IS NULL THEN 0.0 ELSE round(len(list_filter(top, lambda s: regexp_matches(lower(concat(coalesce(j.title, ''), chr(10), coalesce(j.description, ''))), '\\b' || regexp_escape(replace(s, '_', ' ')) || '\\b'))) / len(top), 6) END::DOUBLE AS skills
FROM applications a JOIN jobs j USING (job_id) LEFT JOIN top8 t USING (candidate_id)""")
def _(spark, sf):
    # As if no job had extracted skills, so that every application is scored by the texts.
    bare = lens(spark, sf, "job_own_skills").withColumn("inferred", F.lit(False)).where("false")
    s = skills(spark, sf)
    scored = mt.pair_scores(applications(spark, sf), mt.job_lists(jobs(spark, sf), bare, s, flag()), mt.credit_maps(profile_skills(spark, sf), s))
    return scored.select(*mt.PAIR, F.round("skills", 6).alias("skills"))


DEGREE_SQL = r"CASE WHEN regexp_matches(lower({0}), '\bph\.?\s?d\b|\bdoctorate\b') THEN 3 WHEN regexp_matches(lower({0}), '\bmaster''?s?\b|\bm\.?\s?tech\b|\bm\.?\s?e\b|\bm\.?\s?sc\b|\bmca\b|\bmba\b|\bpost.?graduate\b') THEN 2 WHEN regexp_matches(lower({0}), '\bbachelor''?s?\b|\bb\.?\s?tech\b|\bb\.?\s?e\b|\bb\.?\s?sc\b|\bbca\b|\bgraduate\b|\bdegree\b') THEN 1 ELSE 0 END"
LEVEL_OF = "CASE WHEN {0} < 0.5 THEN 0 WHEN {0} < 2 THEN 1 WHEN {0} < 5 THEN 2 WHEN {0} < 8 THEN 3 WHEN {0} < 12 THEN 4 ELSE 5 END"
TITLE_LEVEL = r"CASE WHEN regexp_matches(lower(title), '\b(intern|internship|trainee)\b') THEN 0 WHEN regexp_matches(lower(title), '\b(junior|jr|associate|graduate|fresher|entry)\b') THEN 1 WHEN regexp_matches(lower(title), '\b(principal|staff|head|director|architect|vp)\b') THEN 5 WHEN regexp_matches(lower(title), '\b(lead|manager)\b') THEN 4 WHEN regexp_matches(lower(title), '\b(senior|sr)\b') THEN 3 END"
MATCH_SQL = f"""{CREDIT_SQL},
jl AS (SELECT *, {city_sql('location_raw')} AS location, {TITLE_LEVEL} AS title_level, CASE WHEN experience_min IS NOT NULL THEN experience_min ELSE {band_sql('title', POSTING_TITLE_BANDS, 1, 'NULL')} END AS lo,
  CASE WHEN experience_min IS NOT NULL THEN greatest(coalesce(experience_max, experience_min + 3), experience_min) ELSE {band_sql('title', POSTING_TITLE_BANDS, 2, 'NULL')} END AS hi,
  CASE WHEN {DEGREE_SQL.format('description')} > 0 THEN {DEGREE_SQL.format('description')} ELSE {DEGREE_SQL.format('title')} END AS wanted FROM jobs),
cl2 AS (SELECT candidate_id, experience_years::DOUBLE AS y, {EXPAND_SQL} AS cities, {DEGREE_SQL.format('education')} AS have, education FROM (SELECT *, {city_sql('location')} AS city FROM candidates)),
comp AS (SELECT s.candidate_id, s.job_id, s.skills, j.role, j.posted_at, j.stale, j.salary_min, j.salary_max, j.salary_is_predicted, CASE WHEN lo IS NULL THEN 0.7 WHEN y < lo THEN y / lo WHEN y <= hi THEN 1.0 ELSE greatest(0.5, 1 - (y - hi) / 10) END::DOUBLE AS experience,
  CASE WHEN wanted = 0 OR have >= wanted THEN 1.0 WHEN have > 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS education,
  CASE WHEN work_mode = 'remote' OR location = 'Remote' THEN 1.0 WHEN location IS NULL OR len(cities) = 0 THEN 0.7 WHEN list_contains(cities, location) THEN 1.0
    WHEN location IN ('Delhi', 'Noida', 'Gurugram') AND len(list_intersect(cities, ['Delhi', 'Noida', 'Gurugram'])) > 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS location,
  CASE WHEN coalesce(title_level, CASE WHEN lo IS NOT NULL THEN {LEVEL_OF.format('lo')} END) IS NULL THEN 0.7 ELSE greatest(0.0, 1 - 0.3 * abs(coalesce(title_level, {LEVEL_OF.format('lo')}) - {LEVEL_OF.format('y')})) END::DOUBLE AS seniority,
  (CASE work_mode WHEN 'remote' THEN 1.0 WHEN 'hybrid' THEN 1.0 WHEN 'unknown' THEN 0.7 ELSE 0.0 END + CASE employment_type WHEN 'full_time' THEN 1.0 WHEN 'unknown' THEN 0.7 ELSE 0.0 END
    + CASE WHEN coalesce(salary_max, salary_min) IS NULL OR salary_is_predicted THEN 0.7 WHEN coalesce(salary_max, salary_min) >= 1000000 THEN 1.0 ELSE 0.3 END)::DOUBLE / 3 AS preference
  FROM ss s JOIN jl j USING (job_id) JOIN cl2 c USING (candidate_id)),
ov AS (SELECT *, round(skills * 0.4::DOUBLE + experience * 0.2::DOUBLE + education * 0.1::DOUBLE + location * 0.1::DOUBLE + seniority * 0.1::DOUBLE + preference * 0.1::DOUBLE, 4) AS overall FROM comp)"""


WISHES = {"work_modes": ["remote", "hybrid"], "employment_types": ["full_time"], "min_lpa": 10.0}


def matches(spark, sf):
    lists, credits = sides(spark, sf)
    return mt.scored_matches(applications(spark, sf), jobs(spark, sf), lists, candidates(spark, sf).drop("role"), credits, known=known(spark, sf), **WISHES)


def _component(name: str, column: str, output: str):
    @query(name, f"WITH {MATCH_SQL} SELECT candidate_id, job_id, round({output}, 4) AS {output} FROM ov")
    def _(spark, sf):
        return matches(spark, sf).select(*mt.PAIR, F.round(column, 4).alias(output))


_component("m08_experience_score", "experience", "experience")
_component("m09_seniority_score", "seniority", "seniority")
_component("m10_education_score", "education_match", "education")
_component("m11_location_score", "location_match", "location")
_component("m12_preference_score", "preference", "preference")


@query("m13_overall_match", f"""
WITH {MATCH_SQL} SELECT candidate_id, job_id, round(skills * 0.4::DOUBLE + experience * 0.2::DOUBLE + education * 0.1::DOUBLE + location * 0.1::DOUBLE + seniority * 0.1::DOUBLE + preference * 0.1::DOUBLE, 9) AS overall FROM ov""")
def _(spark, sf):
    # Nine digits: the published score has four, where both engines may round a tie differently.
    w = mt.MATCH_WEIGHTS
    exact = sum((F.col(c) * w[n] for n, c in [("experience", "experience"), ("education", "education_match"), ("location", "location_match"),
                                              ("seniority", "seniority"), ("preference", "preference")]), F.col("skills") * w["skills"])
    return matches(spark, sf).select(*mt.PAIR, F.round(exact, 9).alias("overall"))


@query("m13_match_classes", f"WITH {MATCH_SQL} SELECT CASE WHEN overall >= 0.80 THEN 'Strong' WHEN overall >= 0.65 THEN 'Good' WHEN overall >= 0.45 THEN 'Partial' ELSE 'Weak' END AS match_class, count(*) AS pairs FROM ov GROUP BY 1")
def _(spark, sf):
    return matches(spark, sf).groupBy("match_class").agg(F.count(F.lit(1)).alias("pairs"))


@query("m15_recency", f"""
SELECT job_id, round(CASE WHEN d <= 3 THEN 1.0 ELSE greatest(0.2, 1 - 0.8 * (d - 3) / 42) END::DOUBLE * CASE WHEN stale THEN 0.8 ELSE 1.0 END::DOUBLE, 4) AS recency FROM (SELECT job_id, stale, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 86400e6 AS d FROM jobs)""")
def _(spark, sf):
    return lens(spark, sf, "jobs").select("job_id", F.round(mt.recency(now()), 4).alias("recency"))


@query("j16_market_pairs", f"""
WITH m AS (SELECT candidate_id, target_role AS role, {city_sql('location')} AS city FROM candidates) SELECT r.role, r.city, r.n * j.n AS pairs FROM (SELECT role, city, count(*) AS n FROM m GROUP BY ALL) r JOIN (SELECT role, {city_sql('location_raw')} AS city, count(*) AS n FROM jobs GROUP BY ALL) j USING (role, city)""")
def _(spark, sf):
    # Sizes of the markets both sides meet in, without forming the pairs.
    ask = candidates(spark, sf).groupBy("role", "city").agg(F.count(F.lit(1)).alias("a"))
    offer = jobs(spark, sf).groupBy("role", F.col("location").alias("city")).agg(F.count(F.lit(1)).alias("b"))
    return ask.join(offer, ["role", "city"]).select("role", "city", (F.col("a") * F.col("b")).alias("pairs"))


@query("j19_same_region", f"""
SELECT job_id FROM (SELECT job_id, {city_sql('location_raw')} AS city FROM jobs) WHERE city IN ('Delhi', 'Noida', 'Gurugram')""")
def _(spark, sf):
    return jobs(spark, sf).where(F.size(places.region_members(F.col("location"))) > 0).select("job_id")


@query("u06_wanted_skills", f"""
WITH {PROFILE_SQL}, o AS (SELECT c.candidate_id, p.skill_id, row_number() OVER (PARTITION BY c.candidate_id ORDER BY p.position) AS i FROM candidates c JOIN profile p ON p.role = c.target_role AND p.skill_id NOT IN {BROAD_SQL}
  WHERE NOT EXISTS (SELECT 1 FROM candidate_evidence e WHERE e.candidate_id = c.candidate_id AND e.skill_id = p.skill_id)) SELECT candidate_id, skill_id FROM o WHERE i <= 3""")
def _(spark, sf):
    return mt.unlock_candidates(profile(spark, sf), candidates(spark, sf), lens(spark, sf, "candidate_evidence").select("candidate_id", "skill_id").distinct(), flag())


@query("m17_skill_unlocks")
def _(spark, sf):
    s, people = skills(spark, sf), candidates(spark, sf)
    items, credits = mt.item_lists(job_skills(spark, sf), s, flag()), mt.credit_maps(profile_skills(spark, sf), s)
    wanted = mt.unlock_candidates(profile(spark, sf), people, lens(spark, sf, "candidate_evidence").select("candidate_id", "skill_id").distinct(), flag())
    return mt.unlocked_jobs(applications(spark, sf), jobs(spark, sf), items, people.drop("role"), credits, wanted, known=mt.known_items(s))


# --- postings -------------------------------------------------------------------------------------

SOURCES = {"source_order": ["listings", "fulltext"], "donor_source": "fulltext"}


@query("p14_employment_preference", "SELECT job_id FROM jobs WHERE employment_type IN ('contract', 'unknown')")
def _(spark, sf):
    return po.of_employment(lens(spark, sf, "jobs"), ["contract"]).select("job_id")


@query("p15_unexpired", "SELECT job_id FROM jobs WHERE posted_at >= TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 45 DAY")
def _(spark, sf):
    return po.unexpired(lens(spark, sf, "jobs"), fresh_now()).select("job_id")


@query("t12_newest_first", "SELECT role, job_id, CAST(i AS INT) AS position FROM (SELECT role, job_id, row_number() OVER (PARTITION BY role ORDER BY posted_at DESC, job_id) AS i FROM jobs) WHERE i <= 20")
def _(spark, sf):
    return ranks.top_k(lens(spark, sf, "jobs"), ["role"], [F.desc_nulls_last("posted_at"), F.asc("job_id")], 20).select("role", "job_id", "position")


MERGE_SQL = f"""
k AS (SELECT *, {DUPLICATE_KEY_SQL.replace("coalesce(location, '')", "coalesce(location_raw, '')")} AS dk, length(description) AS n FROM snapshots),
r AS (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY (salary_min IS NOT NULL AND NOT salary_is_predicted) DESC, (salary_min IS NOT NULL) DESC, n DESC, CASE source WHEN 'listings' THEN 0 ELSE 1 END, job_id) AS i, count(*) OVER (PARTITION BY dk) AS copies FROM k),
d AS (SELECT dk, job_id AS donor, n AS dn FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY n DESC, job_id DESC) AS j FROM k WHERE source = 'fulltext' AND job_id - 1000000000 IN (SELECT job_id FROM job_own_skills)) WHERE j = 1)"""


@query("m01_merged_duplicates", f"WITH {MERGE_SQL} SELECT r.job_id, r.source, r.copies FROM r WHERE i = 1")
def _(spark, sf):
    return po.merge_duplicates(lens(spark, sf, "snapshots"), **SOURCES).select("job_id", "source", "copies")


@query("j18_donor_copy", f"WITH {MERGE_SQL} SELECT r.job_id, CASE WHEN r.source <> 'fulltext' AND dn > r.n THEN donor ELSE r.job_id END AS skills_from FROM r LEFT JOIN d USING (dk) WHERE i = 1")
def _(spark, sf):
    # The full texts have the skills extracted from their jobs; a copy without any is no donor.
    have = lens(spark, sf, "job_own_skills").select((F.col("job_id") + 1_000_000_000).alias("job_id")).distinct().withColumn("extracted", F.lit(True))
    rows = lens(spark, sf, "snapshots").join(have, "job_id", "left")
    return po.merge_duplicates(rows, has_skills=F.col("extracted"), **SOURCES).select("job_id", "skills_from")


@query("u09_union_of_sources", "SELECT source, count(*) AS rows FROM snapshots GROUP BY source")
def _(spark, sf):
    rows = lens(spark, sf, "snapshots")
    a, b = rows.where("source = 'listings'"), rows.where("source = 'fulltext'").drop("salary_min", "salary_max")
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query("m02_current_snapshots", """
WITH s AS (SELECT *, max(fetched_at) OVER (PARTITION BY role) AS newest FROM snapshots)
SELECT job_id, role, round((epoch_us(TIMESTAMP '2002-01-01 12:00:00') - epoch_us(fetched_at)) / 3.6e9, 1) AS age_hours, fetched_at < TIMESTAMP '2002-01-01 06:00:00' AS stale FROM s WHERE fetched_at = newest""")
def _(spark, sf):
    rows = lens(spark, sf, "snapshots")
    return po.current_snapshots(rows, ["role"], now()).select("job_id", "role", "age_hours", "stale")


@query("m20_audit_counts", f"""
WITH f AS (SELECT *, CASE job_id % 2 WHEN 0 THEN 'contract' ELSE 'other' END AS employment_type FROM snapshots), g AS (SELECT * FROM f WHERE posted_at >= TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 45 DAY),
k AS (SELECT {DUPLICATE_KEY_SQL.replace("coalesce(location, '')", "coalesce(location_raw, '')")} AS dk FROM g)
SELECT 'fetched' AS step, count(*) AS rows FROM f UNION ALL SELECT 'fresh', count(*) FROM g UNION ALL SELECT 'merged', count(DISTINCT dk) FROM k UNION ALL SELECT 'of_type', count(*) FROM g WHERE employment_type = 'contract'""")
def _(spark, sf):
    rows = lens(spark, sf, "snapshots").withColumn("employment_type", F.when(F.col("job_id") % 2 == 0, "contract").otherwise("other"))
    return po.audit(rows, fresh_now(), ["contract"], **SOURCES)


@query("a20_market_age", """
SELECT role, count(*) AS total_available, round((epoch_us(TIMESTAMP '2002-01-01 12:00:00') - epoch_us(min(fetched_at))) / 3.6e9, 1) AS age_hours FROM snapshots GROUP BY role""")
def _(spark, sf):
    rows = lens(spark, sf, "snapshots").withColumn("total_count", F.lit(1))
    return po.market_age(rows, ["role"], now()).select("role", "total_available", "age_hours")


LAST_ALIAS = WORD_ALIASES[-1][1]
_WORD_CLASS = r"\p{L}\p{M}\p{N}\p{Pc}+#&"


@query("m21_missing_enrichment", rf"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'text'
  WHEN regexp_matches(lower(text), '(^|[^{_WORD_CLASS}.])' || replace('{LAST_ALIAS}', ' ', '[\s\-_]{{0,2}}') || '([^{_WORD_CLASS}]|$)') THEN 'alias' END AS reason FROM documents""")
def _(spark, sf):
    # The stored run lacks one alias and every fifth document, and of every seventh it saw another text.
    docs, s, known = lens(spark, sf, "SELECT doc_id, text FROM documents"), skills(spark, sf), aliases(spark, sf)
    older = known.where(F.col("alias") != LAST_ALIAS)
    before = docs.where(F.col("doc_id") % 5 != 0).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", "text", F.lit("and Python"))).otherwise(F.col("text")))
    stored = en.extracted(before, "doc_id", "text", s, older)
    return en.refreshed(docs, stored, "doc_id", "text", s, known, older).select("doc_id", "reason")


# --- salary ---------------------------------------------------------------------------------------

POINT_SQL = """
pts AS (SELECT *, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN 'no_salary' WHEN salary_is_predicted THEN 'predicted' WHEN salary_min > 0 AND salary_max > 0 AND salary_max / salary_min > 4 THEN 'wide_range' END AS excluded FROM jobs),
mid AS (SELECT *, CASE WHEN excluded IS NULL THEN (coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min)) / 2 END AS point FROM pts),
fen AS (SELECT role, count(point) AS n, quantile_cont(point, 0.25) AS q1, quantile_cont(point, 0.75) AS q3 FROM mid GROUP BY role),
kept AS (SELECT m.*, f.n < 4 OR m.point BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS kept FROM mid m JOIN fen f USING (role) WHERE point IS NOT NULL)"""


@query("y01_posted_points", f"WITH {POINT_SQL} SELECT job_id, excluded, round(point, 1) AS point FROM mid")
def _(spark, sf):
    return sal.posted_points(lens(spark, sf, "jobs")).select("job_id", "excluded", F.round("point", 1).alias("point"))


@query("y02_outlier_trim", f"WITH {POINT_SQL} SELECT job_id, kept FROM kept")
def _(spark, sf):
    return sal.trim_outliers(sal.posted_points(lens(spark, sf, "jobs")), ["role"]).select("job_id", "kept")


@query("w13_outlier_fences", f"WITH {POINT_SQL} SELECT role, round(q1 - 1.5 * (q3 - q1), 1) AS low, round(q3 + 1.5 * (q3 - q1), 1) AS high FROM fen WHERE n >= 4")
def _(spark, sf):
    return sal.outlier_fences(sal.posted_points(lens(spark, sf, "jobs")), ["role"]).select("role", F.round("low", 1).alias("low"), F.round("high", 1).alias("high"))


@query("a21_exclusion_counts", f"WITH {POINT_SQL} SELECT role, excluded AS reason, count(*) AS rows FROM mid WHERE excluded IS NOT NULL GROUP BY ALL UNION ALL SELECT role, 'outlier', count(*) FROM kept WHERE NOT kept GROUP BY role")
def _(spark, sf):
    return sal.exclusion_counts(lens(spark, sf, "jobs"), ["role"])


def step_sql(x: str, step: int) -> str:
    return f"CAST(floor(({x}) / {step} + 0.5) * {step} AS BIGINT)"


POSTED_SQL = f"""{POINT_SQL},
qs AS (SELECT role, count(*) AS n, quantile_cont(point, 0.25) AS q1, quantile_cont(point, 0.5) AS med, quantile_cont(point, 0.75) AS q3 FROM kept WHERE kept GROUP BY role HAVING count(*) >= 5),
posted AS (SELECT role, 'posted_salaries' AS source, {step_sql('q1', 10000)} AS estimated_min, {step_sql('med', 10000)} AS estimated_median, {step_sql('q3', 10000)} AS estimated_max,
  round(least(0.85, 0.45::DOUBLE + 0.03::DOUBLE * n) - CASE WHEN q3 - q1 > med THEN 0.1 ELSE 0.0 END::DOUBLE, 2) AS confidence, n AS sample_size FROM qs)"""


def posted(spark, sf):
    return sal.posted_estimate(lens(spark, sf, "jobs"), ["role"])


@query("y03_posted_estimate", f"WITH {POSTED_SQL} SELECT * FROM posted")
def _(spark, sf):
    return posted(spark, sf)


HISTOGRAM = "SELECT role, floor(salary_min / 200000) * 200000 AS bound, count(*) AS vacancies FROM jobs WHERE salary_min IS NOT NULL GROUP BY role, floor(salary_min / 200000) * 200000"
HIST_SQL = f"""
h AS ({HISTOGRAM}), hw AS (SELECT role, bound + coalesce(lead(bound) OVER (PARTITION BY role ORDER BY bound) - bound, bound - lag(bound) OVER (PARTITION BY role ORDER BY bound), nullif(bound, 0), 100000) / 2 AS point, vacancies AS weight FROM h),
hc AS (SELECT *, sum(weight) OVER (PARTITION BY role ORDER BY point) AS cum, sum(weight) OVER (PARTITION BY role) AS total FROM hw),
hist AS (SELECT role, 'histogram' AS source, {step_sql('min(point) FILTER (cum >= 0.25 * total)', 10000)} AS estimated_min, {step_sql('min(point) FILTER (cum >= 0.5 * total)', 10000)} AS estimated_median,
  {step_sql('min(point) FILTER (cum >= 0.75 * total)', 10000)} AS estimated_max, 0.5::DOUBLE AS confidence, CAST(max(total) AS BIGINT) AS sample_size FROM hc GROUP BY role HAVING max(total) >= 20)"""


def histogram(spark, sf):
    return lens(spark, sf, HISTOGRAM).withColumn("bound", F.col("bound").cast("long"))


@query("w10_histogram_points", f"WITH {HIST_SQL} SELECT role, point::DOUBLE AS point, weight FROM hw")
def _(spark, sf):
    return sal.histogram_points(histogram(spark, sf), ["role"]).withColumn("point", F.col("point").cast("double"))


@query("y04_histogram_estimate", f"WITH {HIST_SQL} SELECT * FROM hist")
def _(spark, sf):
    return sal.histogram_estimate(histogram(spark, sf), ["role"])


TIER_SQL = "CASE WHEN y < 3 THEN 'entry' WHEN y <= 5 THEN 'mid' ELSE 'senior' END"
PCT_SQL = f"""{BANDS_SQL},
rq AS (SELECT candidate_id, target_role AS role, y, city, {TIER_SQL} AS tier, CASE WHEN city IN ('Delhi', 'Noida', 'Gurugram') THEN 'Delhi NCR' ELSE city END AS metro FROM (SELECT candidate_id, target_role, experience_years::DOUBLE AS y, {city_sql('location')} AS city FROM candidates)),
pj AS (SELECT r.*, t.p25 AS t25, t.p50 AS t50, t.p75 AS t75, coalesce(t.sample_size, 0) AS tn, o.p25 AS o25, o.p50 AS o50, o.p75 AS o75, o.sample_size AS onn, c.p50 AS c50, coalesce(c.sample_size, 0) AS cn FROM rq r
  LEFT JOIN bands t ON t.role = r.role AND t.band = concat('exp:', r.tier) LEFT JOIN bands o ON o.role = r.role AND o.band = 'onsite' LEFT JOIN bands c ON c.role = r.role AND c.band = concat('city:', r.metro)),
pct AS (SELECT candidate_id, role, CASE WHEN tn >= 30 THEN t25 ELSE o25 END * CASE WHEN tn >= 30 AND cn >= 50 AND onn IS NOT NULL THEN c50 / o50 ELSE 1 END * 100000 AS p25,
  CASE WHEN tn >= 30 THEN t50 ELSE o50 END * CASE WHEN tn >= 30 AND cn >= 50 AND onn IS NOT NULL THEN c50 / o50 ELSE 1 END * 100000 AS p50,
  CASE WHEN tn >= 30 THEN t75 ELSE o75 END * CASE WHEN tn >= 30 AND cn >= 50 AND onn IS NOT NULL THEN c50 / o50 ELSE 1 END * 100000 AS p75, CASE WHEN tn >= 30 THEN tn ELSE onn END AS sample_size,
  CASE WHEN tn >= 30 AND cn >= 50 AND onn IS NOT NULL THEN 'experience_x_city_ratio' WHEN tn >= 30 THEN 'experience_bucket' ELSE 'overall' END AS method, CASE WHEN tn >= 30 THEN tier END AS tier FROM pj WHERE tn >= 30 OR onn IS NOT NULL)"""


def percentiles(spark, sf):
    return sal.percentile_salary(candidates(spark, sf), role_bands(spark, sf))


@query("y05_percentile_salary", f"WITH {PCT_SQL} SELECT candidate_id, role, round(p50, 1) AS p50, sample_size, method, tier FROM pct")
def _(spark, sf):
    return percentiles(spark, sf).select("candidate_id", "role", F.round("p50", 1).alias("p50"), "sample_size", "method", "tier")


@query("y10_experience_bucket", "SELECT candidate_id, CASE WHEN y < 1 THEN 'LESS_THAN_ONE' WHEN y < 4 THEN 'ONE_TO_THREE' WHEN y < 7 THEN 'FOUR_TO_SIX' WHEN y < 10 THEN 'SEVEN_TO_NINE' WHEN y < 15 THEN 'TEN_TO_FOURTEEN' ELSE 'ABOVE_FIFTEEN' END AS bucket FROM (SELECT candidate_id, experience_years::DOUBLE AS y FROM candidates)")
def _(spark, sf):
    return candidates(spark, sf).select("candidate_id", sal.experience_bucket(F.col("experience_years")).alias("bucket"))


ESTIMATES = "SELECT role, location_raw, CASE job_id % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ONE_TO_THREE' ELSE 'SEVEN_TO_NINE' END AS bucket, min(salary_min) AS min, CAST(floor(avg(salary_min)) AS BIGINT) AS median, max(salary_min) AS max, count(*) AS count, TIMESTAMP '2001-12-30 00:00:00' AS fetched_at FROM jobs WHERE salary_min IS NOT NULL GROUP BY role, location_raw, job_id % 3"


def estimates(spark, sf):
    rows = lens(spark, sf, ESTIMATES)
    return rows.select("role", places.normalize_city(F.col("location_raw")).alias("city"), "bucket", "min", "median", "max", "count",
                       F.when(F.col("count") > 2, "HIGH").otherwise("LOW").alias("label"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))


@query("y11_estimate_lookup")
def _(spark, sf):
    return sal.estimate_lookup(candidates(spark, sf), estimates(spark, sf), now()).select("candidate_id", "role", "city", "bucket", "median")


@query("y07_two_source_check")
def _(spark, sf):
    found = sal.estimate_lookup(candidates(spark, sf), estimates(spark, sf), now()).drop("role", "city", "bucket", "fetched_at")
    return sal.two_source_estimate(percentiles(spark, sf), found, ["candidate_id"]).drop("source")


BASE_SQL = "base AS (SELECT title AS role, 'baseline' AS source, CAST(1125000 AS BIGINT) AS estimated_min, CAST(1500000 AS BIGINT) AS estimated_median, CAST(1880000 AS BIGINT) AS estimated_max, 0.3::DOUBLE AS confidence, CAST(0 AS BIGINT) AS sample_size FROM occupations)"
MARKET_SQL = f"""{POSTED_SQL}, {HIST_SQL}, {BASE_SQL.replace('1125000', '1130000')},
src AS (SELECT 1 AS pri, * EXCLUDE (source) FROM posted UNION ALL SELECT 4, * EXCLUDE (source) FROM hist UNION ALL SELECT 5, * EXCLUDE (source) FROM base),
market AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY pri) AS i FROM src) WHERE i = 1)"""


def market(spark, sf):
    occ = lens(spark, sf, "SELECT title AS role FROM occupations")
    seen = sal.posted_estimate(lens(spark, sf, "jobs"), ["role"])
    hist = sal.histogram_estimate(histogram(spark, sf), ["role"])
    base = sal.baseline_estimate(occ.withColumn("median_lpa", F.lit(15.0)), ["role"])
    return sal.market_estimate(occ, [seen, hist, base], ["role"])


@query("y06_market_estimate", f"WITH {MARKET_SQL} SELECT role, estimated_min, estimated_median, estimated_max, sample_size FROM market")
def _(spark, sf):
    return market(spark, sf).select("role", "estimated_min", "estimated_median", "estimated_max", "sample_size")


VALUE_SQL = f"""{MARKET_SQL},
v AS (SELECT a.candidate_id, j.job_id, j.salary_min, j.salary_max, j.salary_is_predicted, m.*, 0.5::DOUBLE + (a.job_id % 50) / 100.0::DOUBLE AS ms, c.experience_years::DOUBLE AS y FROM applications a JOIN jobs j USING (job_id) JOIN candidates c USING (candidate_id) JOIN market m ON m.role = j.role),
vv AS (SELECT *, greatest(0.8, least(1.2, 1 + 0.2::DOUBLE * (ms - 0.7::DOUBLE))) AS adj, greatest(0.0, least(1.0, (y - 2) / 4)) AS pos FROM v),
val AS (SELECT *, {step_sql('(estimated_min + pos * (estimated_max - estimated_min)) * adj - (estimated_max - estimated_min) * (0.15::DOUBLE + 0.35::DOUBLE * (1 - confidence))', 10000)} AS value_min,
  {step_sql('(estimated_min + pos * (estimated_max - estimated_min)) * adj + (estimated_max - estimated_min) * (0.15::DOUBLE + 0.35::DOUBLE * (1 - confidence))', 10000)} AS value_max FROM vv)"""


def values(spark, sf):
    base = applications(spark, sf).join(lens(spark, sf, "jobs").select("job_id", "role", "salary_min", "salary_max", "salary_is_predicted"), "job_id") \
        .join(candidates(spark, sf).select("candidate_id", "experience_years"), "candidate_id").join(market(spark, sf), "role")
    band = F.struct(F.lit(2.0).alias("min"), F.lit(6.0).alias("max"))
    return sal.candidate_value(base, match=0.5 + (F.col("job_id") % 50) / 100.0, years=F.col("experience_years"), band=band)


@query("y08_candidate_value", f"WITH {VALUE_SQL} SELECT candidate_id, job_id, value_min, value_max FROM val")
def _(spark, sf):
    return values(spark, sf).select("candidate_id", "job_id", "value_min", "value_max")


NEGOTIATE_SQL = f"""{VALUE_SQL},
ng AS (SELECT *, (salary_min IS NOT NULL OR salary_max IS NOT NULL) AND NOT salary_is_predicted AS posted, coalesce(salary_min, salary_max) AS plo, coalesce(salary_max, salary_min) AS phi, (value_min + value_max) / 2 AS vm FROM val),
nt AS (SELECT *, CASE WHEN posted AND phi >= value_max THEN value_max WHEN posted AND phi >= vm THEN phi ELSE vm END AS target, CASE WHEN posted AND phi >= vm THEN greatest(plo, value_min) WHEN posted THEN greatest(phi, value_min) ELSE value_min END AS floor_ FROM ng)"""


@query("y09_negotiation", f"WITH {NEGOTIATE_SQL} SELECT candidate_id, job_id, {step_sql('target', 50000)} AS recommended_target, {step_sql('least(floor_, target)', 50000)} AS reasonable_minimum FROM nt")
def _(spark, sf):
    return sal.negotiate(values(spark, sf)).select("candidate_id", "job_id", "recommended_target", "reasonable_minimum")


@query("y12_source_band", f"""
WITH {PCT_SQL} SELECT candidate_id, CASE tier WHEN 'entry' THEN 0.0 WHEN 'mid' THEN 3.0 WHEN 'senior' THEN 5.0 ELSE 1.0 END::DOUBLE AS lo, CASE tier WHEN 'entry' THEN 3.0 WHEN 'mid' THEN 5.0 WHEN 'senior' THEN 12.0 ELSE 9.0 END::DOUBLE AS hi FROM pct""")
def _(spark, sf):
    role = F.struct(F.lit(1.0).alias("min"), F.lit(9.0).alias("max"))
    band = sal.source_band(F.lit("market_percentiles"), F.col("tier"), F.lit(None).cast("string"), role)
    return percentiles(spark, sf).select("candidate_id", band["min"].alias("lo"), band["max"].alias("hi"))


# --- ranking with the market's own median ----------------------------------------------------------

PAY_SQL = "CASE WHEN salary_is_predicted OR coalesce(salary_min, salary_max) IS NULL OR median IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + ((coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min)) / 2 - median) / (2.0 * median))) END::DOUBLE"


def ranked_jobs(spark, sf):
    """Jobs with the median of their market's estimate."""
    return jobs(spark, sf).join(market(spark, sf).select("role", F.col("estimated_median").alias("median")), "role", "left")


def ranks_of(spark, sf, k=None):
    lists, credits = sides(spark, sf)
    offers = mt.rank_facts(ranked_jobs(spark, sf), F.col("median"), now())
    scored = mt.scored_matches(applications(spark, sf), offers, lists, candidates(spark, sf).drop("role"), credits, known=known(spark, sf), **WISHES)
    return mt.rank_jobs(scored, F.col("median"), now(), k=k)


@query("m14_salary_attractiveness", f"""
WITH {MARKET_SQL} SELECT job_id, {decimal_round(PAY_SQL, 9)} AS salary_score FROM (SELECT j.*, m.estimated_median AS median FROM jobs j LEFT JOIN market m USING (role))""")
def _(spark, sf):
    return ranked_jobs(spark, sf).select("job_id", F.round(mt.salary_attractiveness(F.col("median")), 9).alias("salary_score"))


RANK_SQL = f"""{MATCH_SQL}, {MARKET_SQL},
rs AS (SELECT *, {PAY_SQL} AS pay,
  (CASE WHEN posted_at IS NULL THEN 0.5 WHEN d <= 3 THEN 1.0 ELSE greatest(0.2, 1 - 0.8 * (d - 3) / 42) END::DOUBLE * CASE WHEN stale THEN 0.8 ELSE 1.0 END::DOUBLE) AS fresh
  FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(posted_at)) / 86400e6 AS d FROM ov LEFT JOIN (SELECT role, estimated_median AS median FROM market) m USING (role))),
rk AS (SELECT candidate_id, job_id, overall, posted_at, {decimal_round("overall * 0.55::DOUBLE + location * 0.15::DOUBLE + experience * 0.1::DOUBLE + pay * 0.1::DOUBLE + fresh * 0.1::DOUBLE", 4)} AS rank_score FROM rs),
placed AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank_score DESC, overall DESC, posted_at DESC NULLS LAST, job_id) AS position FROM rk)"""


@query("m16_ranked_jobs", f"WITH {RANK_SQL} SELECT candidate_id, job_id, rank_score FROM rk")
def _(spark, sf):
    return ranks_of(spark, sf).select(*mt.PAIR, "rank_score")


@query("t06_top_jobs", f"WITH {RANK_SQL} SELECT candidate_id, CAST(position AS INT) AS position, job_id, rank_score FROM placed WHERE position <= 10")
def _(spark, sf):
    return ranks_of(spark, sf, 10).select("candidate_id", "position", "job_id", "rank_score")


@query("t13_top_match_mean", f"WITH {RANK_SQL} SELECT candidate_id, round(avg(overall), 4) AS mean_match FROM placed WHERE position <= 5 GROUP BY candidate_id")
def _(spark, sf):
    return mt.top_match_mean(ranks_of(spark, sf, 5)).withColumn("mean_match", F.round("mean_match", 4))


MARKET_PAIRS_SQL = f"""
market_pairs AS (SELECT c.candidate_id, j.job_id FROM (SELECT candidate_id, target_role AS role, {city_sql('location')} AS city FROM candidates) c JOIN (SELECT job_id, role, {city_sql('location_raw')} AS city FROM jobs) j USING (role, city))"""


@query("j16_top_market_jobs", f"""
WITH {MARKET_PAIRS_SQL}, {RANK_SQL.replace("FROM applications a", "FROM market_pairs a")} SELECT candidate_id, CAST(position AS INT) AS position, job_id, rank_score FROM placed WHERE position <= 10""")
def _(spark, sf):
    # The search reads each of these several times, so they are written once.
    shared_folder(spark)
    offers, lists, credits = [df.checkpoint() for df in (ranked_jobs(spark, sf), *sides(spark, sf))]
    people = candidates(spark, sf)
    best = bm.best_market_jobs(people, offers, lists, people.drop("role", "city"), credits, median=F.col("median"), now=now(), k=10, **WISHES)
    return best.select("candidate_id", "position", "job_id", "rank_score")


@query("y13_chosen_negotiation")
def _(spark, sf):
    # The job a candidate chose is their top ranked one.
    top = ranks_of(spark, sf, 1).select("candidate_id", "job_id", "overall")
    base = top.join(lens(spark, sf, "jobs").select("job_id", "role", "salary_min", "salary_max", "salary_is_predicted"), "job_id") \
        .join(candidates(spark, sf).select("candidate_id", "experience_years"), "candidate_id").join(market(spark, sf), "role")
    valued = sal.candidate_value(base, match=F.col("overall"), years=F.col("experience_years"), band=F.lit(None).cast("struct<min:double,max:double>"))
    return sal.negotiate(valued).select("candidate_id", "job_id", "recommended_target", "reasonable_minimum", "negotiation_confidence", "candidate_range")
