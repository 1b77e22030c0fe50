"""Lenses of candidates, their skills, roles and jobs."""
from __future__ import annotations

from ..sources.seeds import AMBIGUOUS_ALIASES, NON_SKILLS, SKILLS
from .lenses import CITY_NAMES, WORD_ALIASES, values

# Position of a skill in this list decides which candidates and jobs have it.
SKILL_IDS = [s[0] for s in SKILLS]
N = len(SKILL_IDS)


def lens_sql() -> dict[str, str | tuple[str, str]]:
    pairs = [(s[0], a) for s in SKILLS for a in s[7]] + WORD_ALIASES
    return {
        "skills": values([(s[0], s[1], s[2], s[3] or "", s[5], s[6], i) for i, s in enumerate(SKILLS)],
                         "id, display, category, maps_to, difficulty_tier, is_category, load_id"),
        "aliases": values([(i, a, AMBIGUOUS_ALIASES.get(a, "")) for i, a in pairs], "id, alias, rule"),
        "prerequisites": values([(s[0], p) for s in SKILLS for p in s[4]], "id, prerequisite"),
        "non_skills": values(NON_SKILLS, "id, reason"),
        # Every customer is a candidate; the parts of their orders' lines decide their skills.
        "candidates": """
            SELECT c.c_custkey AS candidate_id, c.c_nationkey AS nationkey, n.raw_city AS location,
              floor(abs(c.c_acctbal) / 100) / 10 AS experience_years,
              CASE c.c_mktsegment WHEN 'BUILDING' THEN 'B.Tech Civil' WHEN 'MACHINERY' THEN 'Master of Science'
                WHEN 'HOUSEHOLD' THEN '' ELSE 'Diploma in Arts' END AS education, p.occupation AS target_role, p.soc_code
            FROM customer c JOIN city_names n ON n.nationkey = c.c_nationkey
            JOIN parts_coded p ON p.p_partkey = c.c_custkey % (SELECT count(*) FROM part)""",
        # Spark deals the lines by candidate before the distinct, so that all that is grouped by candidate later stays there.
        "candidate_evidence": (
            f"""
            SELECT DISTINCT e.candidate_id, s.id AS skill_id,
              CASE e.line % 4 WHEN 0 THEN 'work_supported' WHEN 1 THEN 'project_supported' WHEN 2 THEN 'resume_mentioned' ELSE 'self_reported' END AS evidence
            FROM (SELECT /*+ REPARTITION(candidate_id) */ o.o_custkey AS candidate_id, CAST(l.l_partkey % {N} AS INT) AS k, l.l_linenumber AS line
              FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) e JOIN skills s ON s.load_id = e.k""",
            f"""
            SELECT DISTINCT o.o_custkey AS candidate_id, s.id AS skill_id,
              CASE l.l_linenumber % 4 WHEN 0 THEN 'work_supported' WHEN 1 THEN 'project_supported' WHEN 2 THEN 'resume_mentioned' ELSE 'self_reported' END AS evidence
            FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
            JOIN skills s ON s.load_id = l.l_partkey % {N}"""),
        "candidate_claims": (
            f"""
            SELECT DISTINCT candidate_id, skill_id, 1 + (candidate_id + length(skill_id)) % 5 AS claimed
            FROM (SELECT /*+ REPARTITION(candidate_id) */ o.o_custkey AS candidate_id, s.id AS skill_id
              FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN skills s ON s.load_id = l.l_partkey % {N}
              WHERE (o.o_custkey + length(s.id)) % 3 = 0) e""",
            """
            SELECT DISTINCT candidate_id, skill_id, 1 + (candidate_id + length(skill_id)) % 5 AS claimed
            FROM candidate_evidence WHERE (candidate_id + length(skill_id)) % 3 = 0"""),
        # What a role asks for: the skills of its postings, most mentioned first, by name, with a demand weight.
        "role_mentions": """
            SELECT p.occupation AS target_role, s.skill_name, count(*) AS n
            FROM posting_skills s JOIN postings p ON p.posting_id = s.posting_id GROUP BY p.occupation, s.skill_name""",
        "role_skills": """
            SELECT target_role, skill_name, rank, CASE WHEN rank % 4 = 3 THEN NULL ELSE round(n * 1.0 / top, 4) END AS weight FROM (
              SELECT target_role, skill_name, n, max(n) OVER (PARTITION BY target_role) AS top,
                row_number() OVER (PARTITION BY target_role ORDER BY n DESC, skill_name) - 1 AS rank FROM role_mentions) t""",
        # Postings as jobs: the source, the mode and the type follow from the key.
        "jobs": """
            SELECT p.posting_id AS job_id, p.title, p.occupation AS role, p.company, c.raw_city AS location_raw, p.listed_year, p.posted_at,
              CASE p.posting_id % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS work_mode,
              CASE p.posting_id % 4 WHEN 0 THEN 'full_time' WHEN 1 THEN 'contract' WHEN 2 THEN 'internship' ELSE 'unknown' END AS employment_type,
              p.experience_min, p.experience_max, CAST(floor(p.salary_min * 5) AS BIGINT) AS salary_min, CAST(floor(p.salary_max * 5) AS BIGINT) AS salary_max,
              p.posting_id % 10 = 0 AS salary_is_predicted, p.posting_id % 6 = 0 AS stale,
              concat(p.title, CASE p.posting_id % 4 WHEN 0 THEN ' needs a Master''s degree' WHEN 1 THEN ' for any graduate' WHEN 2 THEN ' with PhD' ELSE ' welcome' END) AS description
            FROM postings p JOIN city_names c ON c.nationkey = p.nationkey""",
        "job_own_skills": """
            SELECT DISTINCT m.posting_id AS job_id, m.occupation_context AS role, m.skill_normalized AS skill_id FROM skill_mentions m
            WHERE m.skill_normalized <> 'gender' AND m.skill_normalized <> 'bonus'""",
        # Who applied where: one pair per distinct (order, part of one of its lines).
        "applications": (
            """
            SELECT DISTINCT job_id, candidate_id FROM (
              SELECT /*+ REPARTITION(job_id) */ l.l_orderkey AS job_id, l.l_partkey % (SELECT count(*) FROM customer) AS candidate_id FROM lineitem l) a""",
            """
            SELECT DISTINCT l.l_orderkey AS job_id, l.l_partkey % (SELECT count(*) FROM customer) AS candidate_id FROM lineitem l"""),
        "snapshots": """
            SELECT job_id, role, title, company, location_raw, posted_at, 'listings' AS source, salary_min, salary_max, salary_is_predicted,
              description, TIMESTAMP '2002-01-01 00:00:00' + INTERVAL 1 HOUR AS fetched_at FROM jobs
            UNION ALL
            SELECT job_id + 1000000000, role, title, concat(company, ' Pvt Ltd'), location_raw, posted_at, 'fulltext', NULL, NULL, FALSE,
              concat(description, ' and a longer text'), TIMESTAMP '2002-01-01 08:00:00' FROM jobs WHERE job_id % 3 <> 0""",
    }
