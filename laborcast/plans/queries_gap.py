"""Gap analysis and roadmaps over every candidate and the role they aim for."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..operators import gap, roadmap, taxonomy as tax, vectors as vec
from .catalog import decimal_round, query
from .lenses import lens
from .queries_scalars import band_sql, initcap_sql, slug_sql
from .queries_text import CLOSURE_SQL, LEVEL_SQL, LOOKUP_SQL, lookup, profile_skills, skills

REQUIRED_SQL = f"""{LOOKUP_SQL},
rq AS (SELECT r.target_role, r.rank, r.weight, coalesce(v.skill_id, regexp_replace({slug_sql('r.skill_name')}, '_+', '_', 'g')) AS skill_id, s.display AS known, regexp_replace({slug_sql('r.skill_name')}, '_+', '_', 'g') AS slug
  FROM role_skills r LEFT JOIN resolved v ON v.name = r.skill_name LEFT JOIN skills s ON s.id = v.skill_id
  WHERE regexp_replace({slug_sql('r.skill_name')}, '_+', '_', 'g') NOT IN (SELECT id FROM non_skills) AND r.skill_name NOT IN (SELECT id FROM non_skills)),
rd AS (SELECT target_role, skill_id, min(rank) AS rank, arg_min(coalesce(known, {initcap_sql("replace(slug, '_', ' ')")}), rank) AS display, arg_max(weight, rank) FILTER (weight IS NOT NULL) AS weight FROM rq GROUP BY target_role, skill_id),
rp AS (SELECT *, row_number() OVER (PARTITION BY target_role ORDER BY rank) - 1 AS position FROM rd),
required AS (SELECT *, CASE WHEN weight IS NOT NULL THEN greatest(0.0, least(1.0, weight::DOUBLE)) ELSE 1 / (1 + 0.15::DOUBLE * position) END AS importance FROM rp),
need AS (SELECT *, CASE WHEN weight IS NOT NULL THEN CASE WHEN importance >= 0.85 THEN 4 WHEN importance >= 0.70 THEN 3 ELSE 2 END ELSE CASE WHEN position < 3 THEN 3 ELSE 2 END END AS required_level,
  CASE WHEN importance >= 0.80 THEN 'High' WHEN importance >= 0.60 THEN 'Medium' ELSE 'Low' END AS priority FROM required)"""


def required(spark, sf):
    base = gap.required_skills(lens(spark, sf, "role_skills"), skills(spark, sf), lookup(spark, sf), lens(spark, sf, "non_skills"))
    return gap.with_importance(base)


@query("g02_importance", f"WITH {REQUIRED_SQL} SELECT target_role, skill_id, round(importance, 4) AS importance FROM need")
def _(spark, sf):
    return required(spark, sf).select("target_role", "skill_id", F.round("importance", 4).alias("importance"))


@query("w06_rank_decay", "SELECT target_role, skill_name, round(1 / (1 + 0.15::DOUBLE * rank), 4) AS weight FROM role_skills")
def _(spark, sf):
    rows = lens(spark, sf, "role_skills").select("target_role", "skill_name", F.col("rank").alias("position"), F.lit(None).cast("double").alias("weight"))
    return gap.with_importance(rows).select("target_role", "skill_name", F.round("importance", 4).alias("weight"))


@query("g03_required_level", f"WITH {REQUIRED_SQL} SELECT target_role, skill_id, required_level, priority FROM need")
def _(spark, sf):
    return required(spark, sf).select("target_role", "skill_id", "required_level", "priority")


RELATIONS_SQL = f"""{CLOSURE_SQL}, reach AS (SELECT id AS have, ancestor FROM closure UNION ALL SELECT id, id FROM skills),
rel_all AS (SELECT ancestor AS req, id AS have, 2 AS rule FROM closure UNION ALL SELECT s.id, r.have, 3 FROM skills s JOIN reach r ON r.ancestor = s.maps_to WHERE s.maps_to <> ''
  UNION ALL SELECT p.id, r.have, 4 FROM prerequisites p JOIN reach r ON r.ancestor = p.prerequisite UNION ALL SELECT prerequisite, id, 5 FROM prerequisites),
rel AS (SELECT req, have, min(rule) AS rule FROM rel_all WHERE req <> have GROUP BY ALL)"""
GAPS_SQL = f"""{RELATIONS_SQL}, {REQUIRED_SQL}, {LEVEL_SQL},
offers AS (SELECT candidate_id, skill_id, 1 AS rule, skill_id AS have, level, confidence FROM profile_skills UNION ALL SELECT p.candidate_id, r.req, r.rule, p.skill_id, p.level, p.confidence FROM profile_skills p JOIN rel r ON r.have = p.skill_id),
best_offer AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, skill_id ORDER BY rule, level DESC, confidence DESC, have) AS i FROM offers) WHERE i = 1),
gaps AS (SELECT c.candidate_id, c.target_role, n.skill_id, n.display, n.position, n.importance, n.required_level, n.priority, b.have AS via, b.rule, CASE WHEN b.rule <= 2 THEN 'matched' WHEN b.rule IS NOT NULL THEN 'adjacent' ELSE 'missing' END AS status,
  CASE WHEN b.rule <= 2 THEN b.level ELSE 0 END AS current_level FROM candidates c JOIN need n USING (target_role) LEFT JOIN best_offer b ON b.candidate_id = c.candidate_id AND b.skill_id = n.skill_id)"""


def gaps(spark, sf):
    s = skills(spark, sf)
    relations = gap.skill_relations(s, tax.ancestors(s))
    people = lens(spark, sf, "candidates").select("candidate_id", "target_role")
    return gap.gap_rows(people, required(spark, sf), profile_skills(spark, sf), relations)


@query("j15_skill_relations", f"WITH RECURSIVE {RELATIONS_SQL} SELECT e.candidate_id, r.req AS required_id, r.have AS have_id, r.rule FROM rel r JOIN (SELECT DISTINCT candidate_id, skill_id FROM candidate_evidence) e ON e.skill_id = r.have")
def _(spark, sf):
    s = skills(spark, sf)
    held = lens(spark, sf, "candidate_evidence").select("candidate_id", F.col("skill_id").alias("have_id")).distinct()
    return held.join(gap.skill_relations(s, tax.ancestors(s)), "have_id").select("candidate_id", "required_id", "have_id", "rule")


@query("g04_match_status", f"WITH RECURSIVE {GAPS_SQL} SELECT candidate_id, target_role, skill_id, status, via, current_level, required_level - current_level AS gap FROM gaps")
def _(spark, sf):
    return gaps(spark, sf).select("candidate_id", "target_role", "skill_id", "status", "via", "current_level", "gap")


@query("g04_semantic_status")
def _(spark, sf):
    # Skills no rule matched are compared by name: what roles ask for with every skill of the taxonomy.
    need, s, profile = required(spark, sf), skills(spark, sf), profile_skills(spark, sf)
    named = lambda rows, key, name: vec.classes(rows.select(key, vec.gram_vector(F.col(name)).alias("v")).dropDuplicates([key]), key, "v")
    asked, had = named(need, "skill_id", "display"), named(s, "id", "display")
    alike = vec.similar_classes(asked, had, 256, threshold=gap.ADJACENT_AT)
    pairs = alike.join(asked.select(F.col("member").alias("skill_id"), F.col("class").alias("left")), "left") \
        .join(had.select(F.col("member").alias("have_id"), F.col("class").alias("right")), "right").select("skill_id", "have_id", "similarity")
    people = lens(spark, sf, "candidates").select("candidate_id", "target_role")
    rows = gap.gap_rows(people, need, profile, gap.skill_relations(s, tax.ancestors(s)), vec.similar_offers(people, profile, pairs))
    return rows.select("candidate_id", "target_role", "skill_id", "status", "reason", "via", F.col("similarity"), "gap")


@query("k16_similar_vectors")
def _(spark, sf):
    # Every vector against all vectors with the next one's half added to them, so that there are pairs to find.
    rows = lens(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = rows.join(after, "vec_id").select("vec_id", F.zip_with("embedding", "other", lambda a, b: a + 0.5 * b).alias("embedding"))
    found = vec.similar_classes(vec.classes(rows, "vec_id", "embedding"), vec.classes(mixed, "vec_id", "embedding"), 64, threshold=0.82)
    return found.select(F.col("left").alias("vec_id"), F.col("right").alias("mixed_id"), F.round("similarity", 6).alias("similarity"))


@query("w05_best_skill", f"WITH {LEVEL_SQL} SELECT candidate_id, skill_id, level FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY level DESC, confidence DESC, skill_id) AS i FROM profile_skills) WHERE i = 1")
def _(spark, sf):
    order = F.struct((-F.col("level")).alias("a"), (-F.col("confidence")).alias("b"), "skill_id")
    return profile_skills(spark, sf).groupBy("candidate_id").agg(F.min_by(F.struct("skill_id", "level"), order).alias("m")).select("candidate_id", "m.skill_id", "m.level")


SCORE_SQL = f"""{GAPS_SQL},
cov AS (SELECT candidate_id, target_role, sum(importance * CASE status WHEN 'matched' THEN least(1.0, current_level / required_level) WHEN 'adjacent' THEN 0.4 ELSE 0.0 END::DOUBLE) / sum(importance) AS coverage FROM gaps GROUP BY ALL),
sc AS (SELECT c.candidate_id, c.target_role, v.coverage, c.experience_years::DOUBLE AS y, least(1.0, (c.experience_years::DOUBLE + 1) / ({band_sql('c.target_role', titles.GAP_TITLE_BANDS, 1, '0.0')} + 1)) AS f, {band_sql('c.target_role', titles.GAP_TITLE_BANDS, 2, '5.0')} AS hi FROM candidates c JOIN cov v USING (candidate_id, target_role)),
scores AS (SELECT *, {decimal_round('0.85::DOUBLE * coverage + 0.15::DOUBLE * f', 4)} AS match_score FROM sc)"""


def scores(spark, sf):
    band = titles.title_band(F.col("target_role"), titles.GAP_TITLE_BANDS, titles.GAP_DEFAULT_BAND)
    people = lens(spark, sf, "candidates").select("candidate_id", "target_role", F.col("experience_years").cast("double").alias("experience_years"),
                                                  band["min"].alias("role_min"), band["max"].alias("role_max"))
    return gap.gap_scores(gaps(spark, sf), people)


@query("g05_match_score", f"WITH RECURSIVE {SCORE_SQL} SELECT candidate_id, target_role, round(coverage, 3) AS coverage, round(f, 4) AS experience_factor, match_score FROM scores")
def _(spark, sf):
    return scores(spark, sf).select("candidate_id", "target_role", F.round("coverage", 3).alias("coverage"), F.round("experience_factor", 4).alias("experience_factor"),
                                    "match_score")


@query("g06_verdict", f"""
WITH RECURSIVE {SCORE_SQL}, un AS (SELECT p.candidate_id, count(*) AS n FROM profile_skills p WHERE level >= 3 AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.candidate_id = p.candidate_id AND (g.skill_id = p.skill_id OR g.via = p.skill_id)) GROUP BY 1)
SELECT candidate_id, coalesce(n, 0) AS unused_strong, CASE WHEN match_score >= 0.85 AND y > hi AND coalesce(n, 0) >= 3 THEN 'over_qualified' WHEN match_score < 0.60 THEN 'under_skilled' ELSE 'good_fit' END AS verdict FROM scores LEFT JOIN un USING (candidate_id)""")
def _(spark, sf):
    return gap.verdicts(scores(spark, sf), gaps(spark, sf), profile_skills(spark, sf)).select("candidate_id", "unused_strong", "verdict")


@query("g07_skill_buckets", f"""
WITH RECURSIVE {GAPS_SQL}, g AS (SELECT g.*, coalesce(s.is_category, false) AS cat FROM gaps g LEFT JOIN skills s ON s.id = g.skill_id)
SELECT candidate_id, coalesce(string_agg(skill_id, ',' ORDER BY importance DESC, position) FILTER (status = 'matched' AND required_level <= current_level), '') AS matched,
  coalesce(string_agg(skill_id, ',' ORDER BY importance DESC, position) FILTER (status = 'matched' AND required_level > current_level), '') AS weak,
  coalesce(string_agg(skill_id, ',' ORDER BY importance DESC, position) FILTER (status = 'adjacent'), '') AS adjacent,
  coalesce(string_agg(skill_id, ',' ORDER BY cat, importance DESC, position) FILTER (status = 'missing'), '') AS critical_missing FROM g GROUP BY candidate_id""")
def _(spark, sf):
    rows = gap.skill_buckets(gaps(spark, sf), skills(spark, sf))
    return rows.select("candidate_id", *[F.array_join(c, ",").alias(c) for c in ("matched", "weak", "adjacent", "critical_missing")])


@query("g07_advice")
def _(spark, sf):
    s = skills(spark, sf)
    return gap.advice(gaps(spark, sf), profile_skills(spark, sf), s, tax.category_children(s, tax.ancestors(s)))


def items(spark, sf):
    s = skills(spark, sf)
    return roadmap.roadmap_items(gaps(spark, sf), profile_skills(spark, sf), s, tax.ancestors(s))


ITEMS_SQL = f"""{GAPS_SQL}, roots AS (SELECT g.candidate_id, g.target_role, g.skill_id, g.importance, g.position, CASE WHEN status <> 'matched' THEN status ELSE 'weak' END AS kind FROM gaps g LEFT JOIN skills s ON s.id = g.skill_id
  WHERE NOT coalesce(s.is_category, false) AND (status <> 'matched' OR required_level > current_level)),
known AS (SELECT candidate_id, skill_id FROM profile_skills UNION SELECT p.candidate_id, c.ancestor FROM profile_skills p JOIN closure c ON c.id = p.skill_id),
barred AS (SELECT candidate_id, skill_id FROM known UNION SELECT candidate_id, skill_id FROM roots UNION SELECT c.candidate_id, s.id FROM candidates c, skills s WHERE s.is_category),
pull AS (SELECT r.candidate_id, p.prerequisite AS skill_id, r.importance FROM roots r JOIN prerequisites p ON p.id = r.skill_id WHERE r.kind <> 'weak' AND NOT EXISTS (SELECT 1 FROM barred b WHERE b.candidate_id = r.candidate_id AND b.skill_id = p.prerequisite)
  UNION SELECT q.candidate_id, p.prerequisite, q.importance FROM pull q JOIN prerequisites p ON p.id = q.skill_id WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.candidate_id = q.candidate_id AND b.skill_id = p.prerequisite))"""


@query("g08_prerequisite_items", f"""
WITH RECURSIVE {ITEMS_SQL}
SELECT candidate_id, skill_id, kind, round(importance, 4) AS importance FROM roots UNION ALL SELECT candidate_id, skill_id, 'prerequisite', round(max(importance), 4) FROM pull GROUP BY candidate_id, skill_id""")
def _(spark, sf):
    return items(spark, sf).select("candidate_id", "skill_id", "kind", F.round("importance", 4).alias("importance"))


ORDER_SQL = f"""{ITEMS_SQL},
todo AS (SELECT candidate_id, target_role, skill_id, kind, importance, position FROM roots UNION ALL SELECT p.candidate_id, c.target_role, p.skill_id, 'prerequisite', max(p.importance), 1000000 FROM pull p JOIN candidates c USING (candidate_id) GROUP BY p.candidate_id, c.target_role, p.skill_id),
needs AS (SELECT t.candidate_id, t.skill_id, list(p.prerequisite) AS deps FROM todo t JOIN prerequisites p ON p.id = t.skill_id JOIN todo u ON u.candidate_id = t.candidate_id AND u.skill_id = p.prerequisite GROUP BY ALL),
lists AS (SELECT t.candidate_id, t.target_role, list({{'s': t.skill_id, 'd': coalesce(n.deps, [])}} ORDER BY -t.importance, t.position, t.skill_id) AS todo FROM todo t LEFT JOIN needs n USING (candidate_id, skill_id) GROUP BY ALL),
walk AS (SELECT candidate_id, target_role, todo, []::VARCHAR[] AS done FROM lists UNION ALL
  SELECT candidate_id, target_role, todo, list_append(done, next) FROM (SELECT *, list_filter(todo, lambda x: NOT list_contains(done, x.s) AND len(list_filter(x.d, lambda d: NOT list_contains(done, d))) = 0)[1].s AS next FROM walk) t WHERE next IS NOT NULL),
ends AS (SELECT candidate_id, target_role, arg_max(done, len(done)) AS done FROM walk GROUP BY ALL),
ordered AS (SELECT candidate_id, target_role, unnest(done) AS skill_id, CAST(generate_subscripts(done, 1) AS INT) AS place FROM ends),
roadmap AS (SELECT o.candidate_id, o.target_role, o.place, o.skill_id, t.kind FROM ordered o JOIN todo t USING (candidate_id, target_role, skill_id))"""


@query("g09_roadmap_order", f'WITH RECURSIVE {ORDER_SQL} SELECT candidate_id, target_role, place AS "order", skill_id, kind FROM roadmap')
def _(spark, sf):
    return roadmap.ordered_roadmap(items(spark, sf), skills(spark, sf)).select("candidate_id", "target_role", "order", "skill_id", "kind")


@query("g10_roadmap_hours", f"""
WITH RECURSIVE {ORDER_SQL}, h AS (SELECT r.*, CASE coalesce(s.difficulty_tier, 2) WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 60 END * CASE WHEN r.kind IN ('adjacent', 'weak') THEN 0.5 ELSE 1 END AS lo,
  CASE coalesce(s.difficulty_tier, 2) WHEN 1 THEN 25 WHEN 2 THEN 60 ELSE 120 END * CASE WHEN r.kind IN ('adjacent', 'weak') THEN 0.5 ELSE 1 END AS hi FROM roadmap r LEFT JOIN skills s ON s.id = r.skill_id),
i AS (SELECT *, CAST(round_even(lo::DOUBLE, 0) AS INT) AS hours_low, CAST(round_even(hi::DOUBLE, 0) AS INT) AS hours_high FROM h)
SELECT candidate_id, target_role, place AS "order", skill_id, hours_low, hours_high, CAST(ceil(sum(hours_low) OVER w / 8.0) AS INT) AS weeks_low, CAST(ceil(sum(hours_high) OVER w / 8.0) AS INT) AS weeks_high FROM i WINDOW w AS (PARTITION BY candidate_id, target_role ORDER BY place)""")
def _(spark, sf):
    rows = roadmap.ordered_roadmap(items(spark, sf), skills(spark, sf), hours_per_week=8.0)
    return rows.select("candidate_id", "target_role", "order", "skill_id", "hours_low", "hours_high", "weeks_low", "weeks_high")


@query("w09_running_weeks", """
SELECT candidate_id, skill_id, CAST(ceil(sum(h) OVER (PARTITION BY candidate_id ORDER BY skill_id) / 8.0) AS INT) AS weeks FROM (
  SELECT DISTINCT e.candidate_id, e.skill_id, CASE s.difficulty_tier WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 60 END AS h FROM candidate_evidence e JOIN skills s ON s.id = e.skill_id)""")
def _(spark, sf):
    # Every held skill as a milestone without prerequisites, so the order is by name alone.
    plain = skills(spark, sf).withColumn("prerequisites", F.array().cast("array<string>"))
    held = lens(spark, sf, "candidate_evidence").select("candidate_id", "skill_id").distinct().select(
        "candidate_id", F.lit("all").alias("target_role"), "skill_id", F.lit("missing").alias("kind"), F.lit(1.0).alias("importance"), F.lit(0).alias("position"), F.array().cast("array<string>").alias("required_for"))
    return roadmap.ordered_roadmap(held, plain, hours_per_week=8.0).select("candidate_id", "skill_id", F.col("weeks_low").alias("weeks"))
