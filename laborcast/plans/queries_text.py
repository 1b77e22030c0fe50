"""Taxonomy and text extraction over the documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles, taxonomy as tax, textmine
from .catalog import query
from .lens_extra import N
from .lenses import SKILL_NAMES, lens
from .queries_scalars import initcap_sql, slug_sql


def skills(spark, sf):
    pre = lens(spark, sf, "prerequisites").groupBy("id").agg(F.array_sort(F.collect_list("prerequisite")).alias("prerequisites"))
    return lens(spark, sf, "skills").withColumn("maps_to", F.nullif("maps_to", F.lit(""))).join(pre, "id", "left") \
        .withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast("array<string>")))


def aliases(spark, sf):
    return lens(spark, sf, "aliases").withColumn("rule", F.nullif("rule", F.lit("")))


def documents(spark, sf):
    return lens(spark, sf, "SELECT doc_id, text FROM documents")


@query("k01_dictionary_extraction")
def _(spark, sf):
    hits = textmine.skill_hits(documents(spark, sf), "doc_id", "text", skills(spark, sf), aliases(spark, sf))
    return hits.groupBy("doc_id", "skill_id").agg(F.count(F.lit(1)).alias("mentions"))


@query("k02_context_rules")
def _(spark, sf):
    # Posting skill lists read as text.
    texts = lens(spark, sf, "skill_lists").withColumn("text", F.concat(F.lit("Skills: "), "skills_text", F.lit(".\nWe use Go daily; spark joy.")))
    return textmine.skill_hits(texts, "posting_id", "text", skills(spark, sf), aliases(spark, sf)).select("posting_id", "skill_id", "surface", "start")


@query("k03_overlap_resolution")
def _(spark, sf):
    hits = textmine.skill_hits(documents(spark, sf), "doc_id", "text", skills(spark, sf), aliases(spark, sf))
    return textmine.document_skills(hits, "doc_id").withColumn("surfaces", F.array_join("surfaces", "|"))


@query("w14_longest_match")
def _(spark, sf):
    spans = lens(spark, sf, "SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 40 * 10 + l_linenumber AS start, l_linenumber AS words FROM lineitem") \
        .withColumn("surface", F.repeat(F.lit("x"), F.col("words"))).withColumn("skill_id", F.lit("s")).withColumn("load_id", F.lit(0))
    return textmine.longest_first(spans, "doc_id").select("doc_id", "start", "words")


LOOKUP_SQL = rf"""
spell AS (SELECT id, lower(display) AS alias, load_id, 0 AS n FROM skills UNION ALL SELECT a.id, a.alias, s.load_id, 1 FROM aliases a JOIN skills s USING (id)),
by_slug AS (SELECT k, arg_min(id, load_id * 2 + n) AS id FROM (SELECT {slug_sql('alias')} AS k, id, load_id, n FROM spell) GROUP BY k),
by_alias AS (SELECT k, arg_min(id, load_id * 2 + n) AS id FROM (SELECT regexp_replace(regexp_replace(lower(alias), '[\s\-_]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS k, id, load_id, n FROM spell) GROUP BY k),
asked AS (SELECT DISTINCT skill_name AS name FROM posting_skills UNION SELECT DISTINCT upper(id) FROM skills UNION SELECT DISTINCT replace(display, ' ', '-') FROM skills),
resolved AS (SELECT a.name, coalesce(i.id, s.id, c.id, k.id) AS skill_id FROM asked a LEFT JOIN skills i ON i.id = a.name LEFT JOIN by_slug s ON s.k = {slug_sql('a.name')}
  LEFT JOIN skills c ON c.id = regexp_replace({slug_sql('a.name')}, '_+', '_', 'g') LEFT JOIN by_alias k ON k.k = regexp_replace(regexp_replace(lower(a.name), '[\s\-_]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'))"""


def asked_names(spark, sf):
    s = lens(spark, sf, "skills")
    return lens(spark, sf, "posting_skills").select(F.col("skill_name").alias("name")).distinct() \
        .union(s.select(F.upper("id"))).union(s.select(F.replace("display", F.lit(" "), F.lit("-")))).distinct()


def lookup(spark, sf):
    return tax.name_lookup(skills(spark, sf), aliases(spark, sf))


@query("k04_resolve_names", f"WITH {LOOKUP_SQL} SELECT name, skill_id FROM resolved WHERE skill_id IS NOT NULL")
def _(spark, sf):
    return tax.resolve_names(asked_names(spark, sf), "name", lookup(spark, sf))


@query("g01_required_skills", f"""
WITH {LOOKUP_SQL}, q AS (SELECT r.target_role, r.skill_name, r.rank, coalesce(v.skill_id, regexp_replace({slug_sql('r.skill_name')}, '_+', '_', 'g')) AS skill_id, v.skill_id IS NOT NULL AS in_taxonomy FROM role_skills r LEFT JOIN resolved v ON v.name = r.skill_name
  WHERE regexp_replace({slug_sql('r.skill_name')}, '_+', '_', 'g') NOT IN (SELECT id FROM non_skills) AND r.skill_name NOT IN (SELECT id FROM non_skills))
SELECT target_role, skill_id, in_taxonomy, CAST(row_number() OVER (PARTITION BY target_role ORDER BY rank) - 1 AS INT) AS position FROM (SELECT target_role, skill_id, in_taxonomy, min(rank) AS rank FROM q GROUP BY ALL)""")
def _(spark, sf):
    from ..operators.gap import required_skills

    return required_skills(lens(spark, sf, "role_skills"), skills(spark, sf), lookup(spark, sf), lens(spark, sf, "non_skills")) \
        .select("target_role", "skill_id", "in_taxonomy", "position")


CLOSURE_SQL = """
closure AS (SELECT id, maps_to AS ancestor, 1 AS depth FROM skills WHERE maps_to <> '' UNION ALL SELECT c.id, s.maps_to, c.depth + 1 FROM closure c JOIN skills s ON s.id = c.ancestor WHERE s.maps_to <> '')"""


@query("k05_ancestor_closure", f"""
WITH RECURSIVE {CLOSURE_SQL} SELECT m.posting_id, c.id, c.ancestor, c.depth FROM closure c JOIN (SELECT DISTINCT posting_id, skill_normalized FROM skill_mentions) m ON m.skill_normalized = c.id""")
def _(spark, sf):
    mentions = lens(spark, sf, "skill_mentions").select("posting_id", F.col("skill_normalized").alias("id")).distinct()
    return mentions.join(tax.ancestors(skills(spark, sf)), "id").select("posting_id", "id", "ancestor", "depth")


@query("k06_category_children", f"""
WITH RECURSIVE {CLOSURE_SQL}, fan AS (SELECT maps_to AS child, count(*) AS fan FROM skills WHERE maps_to <> '' GROUP BY 1),
r AS (SELECT c.ancestor AS id, c.id AS child, row_number() OVER (PARTITION BY c.ancestor ORDER BY c.depth, coalesce(f.fan, 0) DESC, s.difficulty_tier, c.id) AS position FROM closure c JOIN skills s ON s.id = c.id AND NOT s.is_category LEFT JOIN fan f ON f.child = c.id),
d AS (SELECT skill_normalized AS id, count(*) AS mentions FROM skill_mentions GROUP BY 1)
SELECT r.id, r.child, CAST(position AS INT) AS position, coalesce(d.mentions, 0) AS child_mentions FROM r LEFT JOIN d ON d.id = r.child WHERE position <= 4""")
def _(spark, sf):
    s = skills(spark, sf)
    demand = lens(spark, sf, "skill_mentions").groupBy(F.col("skill_normalized").alias("child")).agg(F.count(F.lit(1)).alias("child_mentions"))
    return tax.category_children(s, tax.ancestors(s)).join(demand, "child", "left").fillna(0, ["child_mentions"])


@query("k07_non_skills", f"""
SELECT DISTINCT p.skill_name AS name, n.reason FROM posting_skills p JOIN non_skills n ON n.id = p.skill_name OR n.id = regexp_replace({slug_sql('p.skill_name')}, '_+', '_', 'g')""")
def _(spark, sf):
    return tax.non_skill_reasons(lens(spark, sf, "posting_skills").select(F.col("skill_name").alias("name")), "name", lens(spark, sf, "non_skills"))


@query("k08_misread_repair")
def _(spark, sf):
    # Scanned text: every i of a posting's skill list is read as l, every o as 0.
    scanned = lens(spark, sf, "skill_lists").withColumn("text", F.translate("skills_text", "io", "l0"))
    return tax.misread_repairs(scanned, "posting_id", "text", skills(spark, sf), aliases(spark, sf))


# The merge hint keeps the texts off the driver: by their size on disk, compressed, they would be broadcast.
RESUME = """
SELECT /*+ MERGE(d) */ c.candidate_id, concat('Candidate ', CAST(c.candidate_id AS STRING), '
Summary
', d.text, '
WORK EXPERIENCE
Data Analyst, Swiggy  Jan ', CAST(2012 + c.candidate_id % 7 AS STRING), ' - Mar ', CAST(2019 + c.candidate_id % 4 AS STRING), '
Used Python, SQL and thatin daily
Acme Corp
Software Intern 06/2011 to 12/2011
Projects
', d.text, '
Technical Skills
Python, Go, C, ', c.target_role, ' | Power BI
Education
B.Tech in Computer Science, IIT Delhi, ', CAST(2010 + c.candidate_id % 5 AS STRING), '
') AS text
FROM candidates c JOIN documents d ON d.doc_id = c.candidate_id % (SELECT count(*) FROM documents)"""


def resumes(spark, sf):
    return lens(spark, sf, RESUME)


@query("k09_sections", r"""
SELECT candidate_id, 'experience' AS section, 4 + 0 * candidate_id AS n_lines FROM candidates UNION ALL SELECT candidate_id, 'skills', 1 + 0 * candidate_id FROM candidates
UNION ALL SELECT candidate_id, 'education', 1 + 0 * candidate_id FROM candidates UNION ALL SELECT candidate_id, 'header', 1 + 0 * candidate_id FROM candidates""")
def _(spark, sf):
    rows = textmine.sections(resumes(spark, sf), "candidate_id", "text").where("section IN ('header', 'experience', 'skills', 'education')")
    return rows.select("candidate_id", "section", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


@query("w08_section_fill_down")
def _(spark, sf):
    rows = textmine.sections(documents(spark, sf), "doc_id", "text")
    return rows.select("doc_id", "section", F.length("body").cast("long").alias("chars"))


def today():
    return F.lit("2026-09-01").cast("date")


@query("k10_work_history", """
SELECT candidate_id, 'Data Analyst' AS title, 'Swiggy' AS company, CAST((2012 + candidate_id % 7) * 12 AS INT) AS start_month, CAST((2019 + candidate_id % 4) * 12 + 2 AS INT) AS end_month, false AS internship FROM candidates
UNION ALL SELECT candidate_id, 'Software Intern', 'Acme Corp', 2011 * 12 + 5, 2011 * 12 + 11, true FROM candidates""")
def _(spark, sf):
    bodies = textmine.sections(resumes(spark, sf), "candidate_id", "text").where("section = 'experience'")
    return textmine.work_history(bodies, "candidate_id", "body", today=today()).select("candidate_id", "title", "company", "start_month", "end_month", "internship")


@query("w11_previous_line")
def _(spark, sf):
    return textmine.work_history(resumes(spark, sf), "candidate_id", "text", today=today()).select("candidate_id", "line_no", "match_no", "title", "company")


@query("k11_education", """
SELECT candidate_id, 'B.Tech' AS degree, 'Computer Science' AS field, 'IIT Delhi' AS institution, CAST(2010 + candidate_id % 5 AS INT) AS year FROM candidates""")
def _(spark, sf):
    bodies = textmine.sections(resumes(spark, sf), "candidate_id", "text").where("section = 'education'")
    return textmine.education(bodies, "candidate_id", "body").select("candidate_id", "degree", "field", "institution", "year")


@query("a23_merged_years", """
WITH s AS (SELECT o_custkey AS candidate_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS a, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 9 AS INT) AS b FROM orders),
m AS (SELECT DISTINCT candidate_id, unnest(range(a, b + 1)) AS month FROM s)
SELECT candidate_id, round_even(count(*) / 12 * 2, 0) / 2 AS years FROM m GROUP BY candidate_id""")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT o_custkey AS candidate_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS start_month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 9 AS INT) AS end_month FROM orders")
    return textmine.merged_years(rows, ["candidate_id"])


@query("w07_interval_merge", """
WITH s AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS INT) AS h, CAST(event_id % 3 AS INT) AS d FROM events), m AS (SELECT DISTINCT user_id, unnest(range(h, h + d + 1)) AS hour FROM s)
SELECT user_id, round_even(count(*) / 12 * 2, 0) / 2 AS years FROM m GROUP BY user_id""")
def _(spark, sf):
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int")
    rows = lens(spark, sf, "SELECT event_id, user_id, ts FROM events").select("user_id", hours.alias("start_month"), (hours + F.col("event_id") % 3).cast("int").alias("end_month"))
    return textmine.merged_years(rows, ["user_id"])


@query("k12_typed_skills")
def _(spark, sf):
    typed = lens(spark, sf, "SELECT p.custkey AS candidate_id, s.skill_name AS name FROM posting_skills s JOIN postings p ON p.posting_id = s.posting_id").distinct()
    return profiles.typed_skills(typed, "candidate_id", "name", skills(spark, sf), aliases(spark, sf)).select("candidate_id", "name", "skill_id", "in_taxonomy")


LEVEL_SQL = """
ev AS (SELECT candidate_id, skill_id, max(CASE evidence WHEN 'work_supported' THEN 4 WHEN 'project_supported' THEN 3 WHEN 'resume_mentioned' THEN 2 ELSE 1 END) AS best,
  bool_or(evidence = 'work_supported') AS w, bool_or(evidence = 'project_supported') AS p FROM candidate_evidence GROUP BY ALL),
lv AS (SELECT *, least(4, CASE best WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE 1 END + CASE WHEN w AND p THEN 1 ELSE 0 END) AS level, CASE best WHEN 4 THEN 0.9 WHEN 3 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.4 END::DOUBLE AS confidence FROM ev),
cl AS (SELECT l.*, c.claimed FROM lv l LEFT JOIN candidate_claims c USING (candidate_id, skill_id)),
profile_skills AS (SELECT candidate_id, skill_id, confidence, CAST(claimed AS BIGINT) AS claimed, w OR p AS supported, CAST(CASE WHEN claimed > level AND NOT (w OR p) THEN greatest(level, least(claimed, 2)) WHEN w OR p THEN greatest(level, least(coalesce(claimed, level), level + 1)) ELSE level END AS INT) AS level,
  coalesce(claimed > level AND NOT (w OR p) AND claimed > 2, false) AS needs_verification FROM cl)"""


def profile_skills(spark, sf):
    graded = profiles.evidence_levels(lens(spark, sf, "candidate_evidence"))
    return profiles.reconcile_claims(graded, lens(spark, sf, "candidate_claims"))


@query("k13_evidence_levels", f"WITH {LEVEL_SQL} SELECT candidate_id, skill_id, CAST(level AS INT) AS level, confidence FROM lv")
def _(spark, sf):
    return profiles.evidence_levels(lens(spark, sf, "candidate_evidence")).select("candidate_id", "skill_id", "level", "confidence")


@query("k14_claimed_levels", f"WITH {LEVEL_SQL} SELECT candidate_id, skill_id, level, needs_verification FROM profile_skills")
def _(spark, sf):
    return profile_skills(spark, sf).select("candidate_id", "skill_id", "level", "needs_verification")


@query("k15_profiles", f"""
WITH {LEVEL_SQL} SELECT c.candidate_id, c.experience_years::DOUBLE AS experience_years, array_to_string(list(p.skill_id ORDER BY p.level DESC, p.confidence DESC, lower(s.display)), ',') AS skills
FROM candidates c JOIN profile_skills p USING (candidate_id) JOIN skills s ON s.id = p.skill_id GROUP BY ALL""")
def _(spark, sf):
    people = lens(spark, sf, "candidates").select("candidate_id", F.col("experience_years").cast("double").alias("experience_years"))
    out = profiles.assemble(people, profile_skills(spark, sf), skills(spark, sf))
    return out.select("candidate_id", "experience_years", F.array_join(F.transform("skills", lambda s: s["skill_id"]), ",").alias("skills"))


@query("k16_name_similarity")
def _(spark, sf):
    left = lens(spark, sf, "role_skills").select("target_role", F.lit("left").alias("side"), F.col("skill_name").alias("name"))
    right = lens(spark, sf, "SELECT r.target_role, s.display AS name FROM (SELECT DISTINCT target_role FROM role_skills) r JOIN skills s ON s.difficulty_tier > 0") \
        .select("target_role", F.lit("right").alias("side"), "name")
    return tax.gram_similarity(left.unionByName(right), ["target_role"], threshold=0.82).withColumn("similarity", F.round("similarity", 4))


@query("k16_vector_cosine", """
WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT e.vec_id, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 4) AS similarity FROM e JOIN c USING (label, i) GROUP BY e.vec_id""")
def _(spark, sf):
    vectors = lens(spark, sf, "SELECT vec_id, label, embedding FROM embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")) \
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return vectors.join(means, "label").select("vec_id", F.round(tax.cosine(F.col("embedding"), F.col("centre")), 4).alias("similarity"))


@query("k17_taxonomy_checks", r"""
WITH keys AS (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(alias), '[\s\-_]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS detail FROM (
  SELECT DISTINCT concat('name of ', skill_id) AS id, concat('evidence ', evidence) AS alias FROM candidate_evidence))
SELECT 'shared_alias' AS problem, min(id) AS id, detail FROM keys GROUP BY detail HAVING count(DISTINCT id) > 1""")
def _(spark, sf):
    # A taxonomy read from the candidate evidence, in which different skills share their aliases on purpose.
    rows = lens(spark, sf, "candidate_evidence").select(F.concat(F.lit("name of "), "skill_id").alias("id"), "evidence").distinct()
    own = rows.select("id").distinct().select("id", F.col("id").alias("display"), F.lit(None).cast("string").alias("maps_to"), F.array().cast("array<string>").alias("prerequisites"), F.lit(0).alias("load_id"))
    spellings = rows.select("id", F.concat(F.lit("evidence "), "evidence").alias("alias"), F.lit(None).cast("string").alias("rule"))
    none = own.select("id", F.col("id").alias("ancestor")).where("false")
    return tax.taxonomy_problems(own, spellings, none)


@query("k18_enriched_postings")
def _(spark, sf):
    rows = lens(spark, sf, "SELECT doc_id, source AS title, text AS description FROM documents")
    out = textmine.enrich_postings(rows, "doc_id", "title", "description", skills(spark, sf), aliases(spark, sf))
    return out.select("doc_id", F.array_join("skills", ",").alias("skills"), F.size("skill_parents").alias("n_parents"))
