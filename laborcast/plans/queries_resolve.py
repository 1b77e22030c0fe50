"""Title resolution, search and the requirements tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..operators import facts, ranks, requirements as req, resolve
from .catalog import query
from .lenses import lens
from .queries_facts import DEMAND_SQL, CURATED, demand_by_code
from .queries_scalars import GROUP_SQL, match_key_sql, title_sql


def aliases(spark, sf):
    # The position of an alias in its list is its load order.
    rows = lens(spark, sf, "title_aliases")
    order = ["staff nurse", "nurse", "clinical nurse", "civil engineer", "site engineer", "data scientist", "cloud data", "electrician",
             "industrial truck", "chef", "heritage civil"]
    return rows.withColumn("load_id", F.array_position(F.array(*[F.lit(o) for o in order]), F.col("raw_title")))


def dictionary(spark, sf):
    occ = lens(spark, sf, "occupations").select("soc_code", "title", F.lit(0).alias("load_id"))
    return resolve.title_dictionary(aliases(spark, sf), lens(spark, sf, "alternate_titles"), occ)


ALIAS_ORDER = ("list_position(['staff nurse', 'nurse', 'clinical nurse', 'civil engineer', 'site engineer', 'data scientist', 'cloud data', 'electrician', "
               "'industrial truck', 'chef', 'heritage civil'], raw_title)")
DICT_SQL = f"""
al AS (SELECT k AS key, arg_max(soc_code, o) AS soc_code, arg_max(confidence, o)::DOUBLE AS confidence, max(o) AS load_id FROM (SELECT {match_key_sql('raw_title')} AS k, soc_code, confidence, {ALIAS_ORDER} AS o FROM title_aliases) GROUP BY k),
alt AS (SELECT k AS key, arg_min(soc_code, load_id) AS soc_code, 0.95::DOUBLE AS confidence, min(load_id) AS load_id FROM (SELECT {match_key_sql('title')} AS k, soc_code, load_id FROM alternate_titles) WHERE k <> '' GROUP BY k),
off AS (SELECT {match_key_sql('title')} AS key, soc_code, 0.90::DOUBLE AS confidence, 0 AS load_id FROM occupations),
dict AS (SELECT *, 'alias_exact' AS method, 1 AS pri FROM al UNION ALL SELECT *, 'alternate_exact', 2 FROM alt UNION ALL SELECT *, 'official_exact', 3 FROM off),
best AS (SELECT key, arg_min(soc_code, pri) AS soc_code, arg_min(confidence, pri) AS confidence, arg_min(method, pri) AS method FROM dict GROUP BY key),
tset AS (SELECT DISTINCT t FROM (SELECT title AS t FROM postings UNION ALL SELECT concat(title, ' developer') FROM postings)),
keyed AS (SELECT t, k, CASE WHEN len(string_split(k, ' ')) >= 2 THEN concat(split_part(k, ' ', 1), ' ', split_part(k, ' ', 2)) END AS prefix FROM (SELECT t, {match_key_sql('t')} AS k FROM tset) WHERE k <> ''),
starts AS (SELECT prefix, arg_min({{'c': soc_code, 'k': key}}, {{'p': pri, 'l': load_id, 'k': key}}) AS x FROM (SELECT *, CASE WHEN len(string_split(key, ' ')) >= 2 THEN concat(split_part(key, ' ', 1), ' ', split_part(key, ' ', 2)) END AS prefix FROM dict) WHERE prefix IS NOT NULL GROUP BY prefix),
rest AS (SELECT t, k, prefix FROM keyed WHERE k NOT IN (SELECT key FROM best) AND prefix IS NOT NULL),
pre AS (SELECT r.t, r.k, coalesce(a.soc_code, s.x.c) AS soc_code, coalesce(a.key, s.x.k) AS target, CASE WHEN a.key IS NOT NULL THEN 'alias_prefix_match' ELSE 'prefix_match' END AS method
  FROM rest r LEFT JOIN al a ON a.key = r.prefix LEFT JOIN starts s ON s.prefix = r.prefix WHERE a.key IS NOT NULL OR s.x IS NOT NULL),
sim AS (SELECT *, list_distinct(string_split(k, ' ')) AS a, list_distinct(string_split(target, ' ')) AS b FROM pre
  WHERE NOT (soc_code = '17-2051.00' AND regexp_matches(k, 'software|developer|java|python|programming|frontend|backend|full stack')) AND NOT (soc_code = '47-2111.00' AND regexp_matches(k, 'software|developer|frontend|backend'))),
resolved AS (SELECT k.t AS title, b.soc_code, b.confidence, b.method FROM keyed k JOIN best b ON b.key = k.k
  UNION ALL SELECT t, soc_code, greatest(0.50, least(0.90, round(0.55::DOUBLE + 0.35::DOUBLE * (0.6::DOUBLE * (len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) + 0.4::DOUBLE * (len(list_intersect(a, b)) / len(a))), 3))), method FROM sim)"""


def resolved(spark, sf):
    rows = lens(spark, sf, "postings").select("title")
    both = rows.unionByName(rows.select(F.concat("title", F.lit(" developer")).alias("title")))
    return resolve.resolve_titles(both, "title", dictionary(spark, sf))


@query("j01_title_resolution", f"WITH {DICT_SQL} SELECT title, soc_code, method FROM resolved")
def _(spark, sf):
    return resolved(spark, sf).select("title", "soc_code", "method")


@query("j02_prefix_confidence", f"WITH {DICT_SQL} SELECT title, confidence FROM resolved WHERE method LIKE '%prefix%'")
def _(spark, sf):
    return resolved(spark, sf).where("method LIKE '%prefix%'").select("title", "confidence")


@query("j03_coded_postings", f"WITH {DICT_SQL} SELECT p.posting_id, r.soc_code, r.method FROM postings p JOIN resolved r USING (title)")
def _(spark, sf):
    rows = lens(spark, sf, "postings").select("posting_id", "title")
    return resolve.apply_codes(rows, "title", resolve.resolve_titles(rows, "title", dictionary(spark, sf))).select("posting_id", "soc_code", "method")


@query("p12_conflict_guard", f"""
SELECT posting_id, soc_code FROM postings WHERE NOT (soc_code = '17-2051.00' AND regexp_matches(concat({title_sql('title')}, CASE WHEN posting_id % 2 = 0 THEN ' java' ELSE '' END), 'software|developer|java|python|programming|frontend|backend|full stack'))
  AND NOT (soc_code = '47-2111.00' AND regexp_matches({title_sql('title')}, 'software|developer|frontend|backend'))""")
def _(spark, sf):
    rows = lens(spark, sf, "postings").withColumn("key", F.concat(titles.normalize_title(F.col("title")), F.when(F.col("posting_id") % 2 == 0, " java").otherwise("")))
    return resolve.without_conflicts(rows, "key").select("posting_id", "soc_code")


@query("j08_mentions_with_code", f"""
WITH {DICT_SQL.replace("SELECT title AS t FROM postings UNION ALL SELECT concat(title, ' developer') FROM postings", "SELECT occupation_context AS t FROM skill_mentions")}
SELECT m.posting_id, m.skill_name, r.soc_code FROM skill_mentions m LEFT JOIN resolved r ON r.title = m.occupation_context""")
def _(spark, sf):
    mentions = lens(spark, sf, "skill_mentions").drop("soc_code")
    codes = resolve.resolve_titles(mentions, "occupation_context", dictionary(spark, sf)).select("occupation_context", "soc_code")
    return mentions.join(codes, "occupation_context", "left").select("posting_id", "skill_name", "soc_code")


@query("u05_token_sets", """
SELECT posting_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM (
  SELECT posting_id, list_distinct(string_split(lower(title), ' ')) AS a, list_distinct(string_split(occupation, ' ')) AS b FROM postings)""")
def _(spark, sf):
    a, b = F.split(F.lower("title"), " "), F.split("occupation", " ")
    return lens(spark, sf, "postings").select("posting_id", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_union(a, b)).cast("long").alias("either"))


# Search queries: every posting title, its last word, and a word in the middle.
QUERIES_SQL = """qs AS (SELECT DISTINCT q AS query, lower(trim(q)) AS q FROM (SELECT title AS q FROM postings UNION ALL SELECT substr(occupation, strpos(occupation, ' ') + 1) FROM postings
  UNION ALL SELECT substr(occupation, 2, 6) FROM postings) WHERE trim(q) <> '')"""


def search_queries(spark, sf):
    rows = lens(spark, sf, "postings").select("title", "occupation")
    tail = F.substr("occupation", F.instr("occupation", " ") + 1)
    return rows.select(F.explode(F.array("title", tail, F.substring("occupation", 2, 6))).alias("query"))


TOK = r"list_filter(regexp_split_to_array(trim(regexp_replace(q, '[^a-z0-9\s]', '', 'g')), '\s+'), lambda w: length(w) > 2)"


@query("t08_best_occupation", f"""
WITH {QUERIES_SQL}, h AS (SELECT q.query, o.soc_code, o.title, CASE WHEN o.title = q.q THEN 1 WHEN contains(o.title, q.q) THEN 2
    WHEN len({TOK}) > 0 AND len(list_filter({TOK}, lambda w: NOT contains(o.title, w))) = 0 THEN 3 END AS stage FROM qs q, occupations o)
SELECT query, soc_code, title, stage FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY stage, length(title), title) AS i FROM h WHERE stage IS NOT NULL) WHERE i = 1""")
def _(spark, sf):
    return resolve.best_occupation(search_queries(spark, sf), lens(spark, sf, "occupations"))


@query("t03_shortest_title", """
WITH w AS (SELECT DISTINCT split_part(title, ' ', 1) AS word FROM occupations), h AS (SELECT w.word, o.title, row_number() OVER (PARTITION BY w.word ORDER BY length(o.title), o.title) AS i FROM w JOIN occupations o ON contains(o.title, w.word))
SELECT word, title FROM h WHERE i = 1""")
def _(spark, sf):
    occ = lens(spark, sf, "occupations")
    words = occ.select(F.split_part("title", F.lit(" "), F.lit(1)).alias("query"))
    return resolve.best_occupation(words, occ).select(F.col("query").alias("word"), "title")


@query("t04_list_occupations", "SELECT soc_code, title FROM occupations ORDER BY title LIMIT 20")
def _(spark, sf):
    return lens(spark, sf, "occupations").select("soc_code", "title").orderBy("title").limit(20)


SEARCH_SQL = f"""{QUERIES_SQL},
named AS (SELECT 1 AS kind, a.soc_code, o.title, raw_title AS term, confidence::DOUBLE AS c FROM title_aliases a JOIN occupations o USING (soc_code)
  UNION ALL SELECT 2, soc_code, title, title, 1.0 FROM occupations UNION ALL SELECT 3, a.soc_code, o.title, a.title, 1.0 FROM alternate_titles a JOIN occupations o USING (soc_code)),
hit AS (SELECT q.query, q.q, n.*, lower(n.term) = q.q AS exact FROM qs q JOIN named n ON contains(lower(n.term), q.q)),
st AS (SELECT query, soc_code, title, kind AS stage, ['alias_exact', 'title_exact', 'alternate_exact'][kind] AS method, CASE kind WHEN 1 THEN c WHEN 2 THEN 1.0 ELSE 0.95 END AS confidence, term FROM hit WHERE exact
  UNION ALL SELECT query, soc_code, title, kind + 3, ['alias_partial', 'title_partial', 'alternate_partial'][kind], CASE kind WHEN 1 THEN round(c * 0.90::DOUBLE, 2) WHEN 2 THEN 0.88 ELSE 0.82 END, term FROM hit
  UNION ALL SELECT query, o.soc_code, o.title, 7, 'token_match', 0.70, o.title FROM qs q JOIN occupations o ON len(list_filter({TOK}, lambda w: contains(o.title, w))) > 0),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, stage ORDER BY length(term), term, soc_code) AS i FROM st) WHERE stage <= 2 OR i <= 5),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, soc_code, stage ORDER BY confidence DESC, length(term), term) AS j FROM cut) WHERE j = 1),
fst AS (SELECT *, min(stage) OVER (PARTITION BY query, soc_code) AS first_stage FROM one),
gate AS (SELECT f.query, f.soc_code, f.first_stage FROM fst f WHERE f.stage = f.first_stage AND (f.stage <= 3 OR (SELECT count(DISTINCT g.soc_code) FROM fst g WHERE g.query = f.query AND g.first_stage < f.stage) < 5)),
pick AS (SELECT f.*, row_number() OVER (PARTITION BY f.query, f.soc_code ORDER BY f.confidence DESC, f.stage) AS z FROM fst f JOIN gate g USING (query, soc_code) WHERE f.stage <= 3 OR f.stage = f.first_stage),
fin AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY confidence DESC, stage, length(term), soc_code) AS INT) AS position FROM pick WHERE z = 1)"""


@query("t07_title_search", f"WITH {SEARCH_SQL} SELECT query, soc_code, title, method, confidence::DOUBLE AS confidence, term AS matched_term, position FROM fin WHERE position <= 5")
def _(spark, sf):
    return resolve.search_titles(search_queries(spark, sf), lens(spark, sf, "occupations"), lens(spark, sf, "title_aliases"), lens(spark, sf, "alternate_titles"))


@query("j11_alias_occupations", """
SELECT o.title, a.raw_title AS term FROM title_aliases a JOIN occupations o USING (soc_code) UNION ALL SELECT o.title, t.title FROM alternate_titles t JOIN occupations o USING (soc_code)""")
def _(spark, sf):
    occ = lens(spark, sf, "occupations").select("soc_code", F.col("title").alias("occupation"))
    alias = lens(spark, sf, "title_aliases").select("soc_code", F.col("raw_title").alias("term"))
    return alias.unionByName(lens(spark, sf, "alternate_titles").select("soc_code", F.col("title").alias("term"))) \
        .join(occ, "soc_code").select(F.col("occupation").alias("title"), "term")


@query("t09_domain_search", f"""
WITH {QUERIES_SQL}, h AS (SELECT q.query AS request, o.soc_code, o.title, CASE WHEN contains(o.title, {TOK}[1]) THEN 3.0 ELSE 1.0 END AS r FROM qs q JOIN occupations o
  ON len(list_filter({TOK}, lambda w: contains(o.title, w) OR contains(lower(o.description), w))) > 0)
SELECT request, soc_code, title, round(least(r * 0.35 + 0.5, 0.98), 2)::DOUBLE AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY r DESC, length(title), title) AS i FROM h) WHERE i <= 10""")
def _(spark, sf):
    requests = search_queries(spark, sf).distinct().withColumn("request", F.col("query"))
    return resolve.domain_search(requests, lens(spark, sf, "occupations")).select("request", "soc_code", "title", "relevance_score")


# --- requirements ---------------------------------------------------------------------------------

WIDE_SQL = """
wide AS (SELECT soc_code, element_id, max(element_name) AS element_name, coalesce(arg_max(data_value, load_id) FILTER (scale_id = 'IM'), 1.0) AS importance,
  coalesce(arg_max(data_value, load_id) FILTER (scale_id = 'LV'), 0.0) AS level, arg_max(n, load_id) AS n, CASE WHEN bool_or(suppress = 'Y') THEN 'Y' ELSE 'N' END AS recommend_suppress,
  CASE WHEN bool_or(not_relevant = 'Y') THEN 'Y' ELSE 'N' END AS not_relevant FROM ratings GROUP BY ALL),
rated AS (SELECT *, round(greatest(0.0, least(1.0, (importance - 1) / 4)), 4) AS importance_norm, round(greatest(0.0, least(1.0, level / 7)), 4) AS level_norm FROM wide)"""


@query("s12_element_ratings", f"WITH {WIDE_SQL} SELECT * EXCLUDE (n) FROM rated")
def _(spark, sf):
    return req.element_ratings(lens(spark, sf, "ratings")).drop("n")


TASK_SCALES = """SELECT soc_code, task_id, task_description, 'IM' AS scale_id, CAST(NULL AS DOUBLE) AS category, importance / 10 AS data_value, load_id FROM tasks
UNION ALL SELECT soc_code, task_id, task_description, 'RT', NULL, 100 - importance, load_id FROM tasks WHERE load_id % 3 <> 0
UNION ALL SELECT soc_code, task_id, task_description, 'FT', 1.0, importance, load_id FROM tasks UNION ALL SELECT soc_code, task_id, task_description, 'FT', 4.0, 100 - importance, load_id FROM tasks"""


@query("s13_task_ratings", f"""
WITH t AS ({TASK_SCALES}) SELECT soc_code, task_id, max(task_description) AS task_description, max(data_value) FILTER (scale_id = 'IM') AS importance, max(data_value) FILTER (scale_id = 'RT') AS relevance,
  round(sum(category * data_value / 100) FILTER (scale_id = 'FT'), 4) AS frequency FROM t GROUP BY soc_code, task_id""")
def _(spark, sf):
    return req.task_ratings(lens(spark, sf, TASK_SCALES)).withColumn("frequency", F.round("frequency", 4))


@query("a19_frequency_distribution", "SELECT soc_code, task_id, round((importance + 4 * (100 - importance)) / 100, 4) AS frequency FROM tasks")
def _(spark, sf):
    return req.task_ratings(lens(spark, sf, TASK_SCALES)).select("soc_code", "task_id", F.round("frequency", 4).alias("frequency"))


DWA_ROWS = "SELECT soc_code, task_id, concat('D', CAST(load_id % 40 AS STRING)) AS dwa_id, concat('Activity ', CAST(load_id % 40 AS STRING)) AS dwa_title FROM tasks UNION ALL SELECT soc_code, task_id, concat('D', CAST(load_id % 40 AS STRING)), concat('Activity ', CAST(load_id % 40 AS STRING)) FROM tasks WHERE load_id % 2 = 0"
IWA_ROWS = "SELECT DISTINCT concat('D', CAST(load_id % 30 AS STRING)) AS dwa_id, concat('I', CAST(load_id % 5 AS STRING)) AS iwa_id, concat('Group ', CAST(load_id % 5 AS STRING)) AS iwa_title, load_id % 30 AS load_id FROM tasks"


@query("s14_work_activities", f"""
WITH d AS ({DWA_ROWS.replace(' AS STRING', ' AS VARCHAR')}), i AS ({IWA_ROWS.replace(' AS STRING', ' AS VARCHAR')}) SELECT DISTINCT d.*, i.iwa_id, i.iwa_title FROM d LEFT JOIN i USING (dwa_id)""")
def _(spark, sf):
    return req.work_activities(lens(spark, sf, DWA_ROWS), lens(spark, sf, IWA_ROWS))


TOOLS = "SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN soc_code ELSE concat(substr(soc_code, 1, 7), '.0', CAST(1 + p_partkey % 2 AS STRING)) END AS soc_code, lower(p_type) AS example, p_brand AS commodity_code, p_type AS commodity_title FROM parts_coded WHERE soc_code NOT LIKE '43%' OR p_partkey % 4 <> 0"


@query("j12_tool_roll_up", f"""
WITH t AS ({TOOLS.replace(' AS STRING', ' AS VARCHAR')}), c AS (SELECT concat(substr(soc_code, 1, 7), '.00') AS soc_code, example, commodity_code, commodity_title FROM t WHERE NOT ends_with(soc_code, '.00'))
SELECT * FROM t UNION ALL SELECT soc_code, example, x.commodity_code, x.commodity_title FROM (SELECT soc_code, example, min({{'commodity_code': commodity_code, 'commodity_title': commodity_title}}) AS x FROM c
  WHERE soc_code IN (SELECT soc_code FROM occupations) AND soc_code NOT IN (SELECT soc_code FROM t) GROUP BY ALL)""")
def _(spark, sf):
    return req.roll_up_tools(lens(spark, sf, TOOLS), lens(spark, sf, "occupations"))


EDU = "SELECT soc_code, '2.D.1' AS element_id, CAST(p_size % 13 AS INT) AS category, round(sum(p_size), 1) AS percent FROM parts_coded GROUP BY soc_code, p_size % 13"
EDU_CAT = "SELECT '2.D.1' AS element_id, CAST(c AS INT) AS category, concat('Category ', CAST(c AS STRING)) AS category_description FROM (SELECT DISTINCT p_size % 13 AS c FROM part) t WHERE c < 11"


def local_education(spark):
    from ..sources.seeds import EDUCATION_LEVELS

    return spark.createDataFrame([(c, local, level) for c, _, local, level in EDUCATION_LEVELS], "category int, local_level string, hierarchy_level int")


def edu_map_sql() -> str:
    from ..sources.seeds import EDUCATION_LEVELS
    from .lenses import values

    return values([(c, local, level) for c, _, local, level in EDUCATION_LEVELS], "category, local_level, hierarchy_level")


@query("j05_education_levels", f"""
WITH e AS ({EDU}), c AS ({EDU_CAT.replace(' AS STRING', ' AS VARCHAR')}), m AS ({edu_map_sql()})
SELECT e.soc_code, e.element_id, e.category, e.percent::DOUBLE AS percent, coalesce(c.category_description, '') AS category_description, m.local_level, m.hierarchy_level FROM e LEFT JOIN c USING (element_id, category) LEFT JOIN m USING (category)""")
def _(spark, sf):
    rows = lens(spark, sf, EDU).withColumn("percent", F.col("percent").cast("double"))
    return req.education_levels(rows, lens(spark, sf, EDU_CAT), local_education(spark))


ZONES = "SELECT soc_code, CAST(1 + length(title) % 5 AS INT) AS job_zone FROM occupations"
ZONE_REF = "SELECT CAST(z AS INT) AS job_zone, concat('Zone ', CAST(z AS STRING)) AS zone_name, concat('Education of zone ', CAST(z AS STRING)) AS education_text FROM (SELECT DISTINCT 1 + p_size % 4 AS z FROM part) t"


@query("j06_zone_reference", f"WITH z AS ({ZONES}), r AS ({ZONE_REF.replace(' AS STRING', ' AS VARCHAR')}) SELECT z.soc_code, z.job_zone, r.zone_name, r.education_text FROM z LEFT JOIN r USING (job_zone)")
def _(spark, sf):
    return req.with_zone_text(lens(spark, sf, ZONES), lens(spark, sf, ZONE_REF))


@query("j07_rating_descriptions", f"""
WITH {WIDE_SQL} SELECT soc_code, element_id AS item_id, coalesce(c.description, element_name) AS item_description, CASE WHEN recommend_suppress = 'Y' OR not_relevant = 'Y' THEN 0 ELSE 1 END AS reliable
FROM rated LEFT JOIN content_model c USING (element_id)""")
def _(spark, sf):
    return req.rating_items("skill", req.element_ratings(lens(spark, sf, "ratings")), lens(spark, sf, "content_model")) \
        .select("soc_code", "item_id", "item_description", "reliable")


RELATED = "SELECT a.soc_code, b.soc_code AS related_soc_code, b.title AS related_title, CASE WHEN substr(a.soc_code, 1, 2) = substr(b.soc_code, 1, 2) THEN 'Primary-Short' ELSE 'Supplemental' END AS relatedness_tier, CAST(length(b.title) AS INT) AS index_val FROM occupations a JOIN occupations b ON split_part(a.title, ' ', 1) = split_part(b.title, ' ', 1) AND a.soc_code <> b.soc_code UNION ALL SELECT a.soc_code, b.soc_code, b.title, 'Primary-Short', CAST(length(b.title) AS INT) FROM occupations a JOIN occupations b ON substr(a.soc_code, 1, 2) = substr(b.soc_code, 1, 2) AND a.soc_code <> b.soc_code AND split_part(a.title, ' ', 1) <> split_part(b.title, ' ', 1)"


@query("j09_related_occupations", f"""
WITH r AS ({RELATED}), z AS ({ZONES}), g AS (SELECT soc_code, {GROUP_SQL} FROM occupations)
SELECT r.soc_code, r.related_soc_code, r.relatedness_tier, r.index_val, g.major_group_title, g.career_cluster, z.job_zone FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY relatedness_tier, index_val, related_soc_code) AS i FROM r) r
LEFT JOIN g ON g.soc_code = r.related_soc_code LEFT JOIN z ON z.soc_code = r.related_soc_code WHERE i <= 6""")
def _(spark, sf):
    domains = lens(spark, sf, "occupations").select("soc_code", titles.major_group(F.col("soc_code")).alias("g")).select("soc_code", "g.*")
    return req.related_occupations(lens(spark, sf, RELATED), domains, lens(spark, sf, ZONES), k=6).drop("related_title", "position")


@query("t11_related_in_order", f"""
WITH r AS ({RELATED}) SELECT soc_code, related_soc_code, CAST(i AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY relatedness_tier, index_val, related_soc_code) AS i FROM r) WHERE i <= 10""")
def _(spark, sf):
    return ranks.top_k(lens(spark, sf, RELATED), ["soc_code"], [F.asc("relatedness_tier"), F.asc("index_val"), F.asc("related_soc_code")], 10) \
        .select("soc_code", "related_soc_code", "position")


TECH = "SELECT soc_code, lower(p_brand) AS example, p_type AS commodity_title, max(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS hot_technology, max(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS in_demand FROM parts_coded GROUP BY soc_code, lower(p_brand), p_type"
RESERVED = ["29-1140.00", "29-1141.00"]


def requirements(spark, sf):
    ratings = req.element_ratings(lens(spark, sf, "ratings"))
    model = lens(spark, sf, "content_model")
    tasks = lens(spark, sf, "tasks").withColumn("importance", F.col("importance") / 10)
    demand = facts.demand_importance(demand_by_code(spark, sf)).drop("position")
    curated = spark.createDataFrame(CURATED, "soc_code string, skill_normalized string, skill_name string").select(
        "soc_code", F.lit("curated").alias("region"), "skill_normalized", "skill_name", F.lit(0).cast("long").alias("posting_count"), F.lit("curated").alias("source"))
    market = demand.select("soc_code", "region", "skill_normalized", "skill_name", "posting_count", "source", "soc_posting_total", "share_of_postings", "importance_norm") \
        .unionByName(curated, allowMissingColumns=True)
    return req.unified_requirements([
        req.rating_items("skill", ratings.where("element_id IN ('2.A.1', '2.A.2')"), model), req.rating_items("knowledge", ratings.where("element_id IN ('2.A.3', '2.A.4')"), model),
        req.rating_items("ability", ratings.where("element_id = '2.A.5'"), model), req.rating_items("work_activity", ratings.where("element_id >= '2.A.6'"), model, flagged=False),
        req.task_items(tasks, reserved_codes=RESERVED), req.activity_items(req.work_activities(lens(spark, sf, DWA_ROWS), lens(spark, sf, IWA_ROWS))),
        req.technology_items(lens(spark, sf, TECH)), req.tool_items(lens(spark, sf, TOOLS)), req.market_items(market)])


def _vc(sql: str) -> str:
    return sql.replace(" AS STRING", " AS VARCHAR")


SLUG = "lower(replace(replace(replace(replace(replace(example, ' ', '_'), '/', '_'), '-', '_'), '(', ''), ')', ''))"
REASON = ("CASE WHEN soc_code IN ('29-1140.00', '29-1141.00') AND (contains(lower(task_description), 'prescribe') OR contains(lower(task_description), 'recommend drug')) THEN 'R' "
          "WHEN contains(lower(task_description), '401(k)') OR contains(lower(task_description), 'irs form') THEN 'F' END")
REQ_SQL = f"""{WIDE_SQL}, {DEMAND_SQL}, dw AS ({_vc(DWA_ROWS)}), te AS ({TECH}), tl AS ({_vc(TOOLS)}),
di AS (SELECT *, round(greatest(0.2, least(1.0, posting_count / greatest(1, max(posting_count) OVER (PARTITION BY soc_code, region)))), 4) AS imp FROM demand50),
u AS (SELECT soc_code, CASE WHEN element_id IN ('2.A.1', '2.A.2') THEN 'skill' WHEN element_id IN ('2.A.3', '2.A.4') THEN 'knowledge' WHEN element_id = '2.A.5' THEN 'ability' ELSE 'work_activity' END AS item_type, element_id AS item_id, element_name AS item_name,
    importance_norm AS imp, level_norm AS lvl, 0 AS hot, 0 AS dem, NULL::DOUBLE AS share, 'onet' AS source, CASE WHEN element_id < '2.A.6' AND (recommend_suppress = 'Y' OR not_relevant = 'Y') THEN 0 ELSE 1 END AS rel, 0 AS pc, NULL::VARCHAR AS reason FROM rated
  UNION ALL SELECT soc_code, 'task', task_id, task_description, round(greatest(0.0, least(1.0, (importance / 10 - 1) / 4)), 4), NULL, 0, 0, NULL, 'onet', 1, 0, {REASON} FROM tasks
  UNION ALL SELECT DISTINCT soc_code, 'dwa', dwa_id, dwa_title, 0.7, NULL, 0, 0, NULL, 'onet', 1, 0, NULL FROM dw
  UNION ALL SELECT soc_code, 'tech', concat('tech_', {SLUG}), example, CASE WHEN hot_technology = 1 THEN 0.85 ELSE 0.5 END, NULL, hot_technology, in_demand, NULL, 'onet', 1, 0, NULL FROM te
  UNION ALL SELECT soc_code, 'tool', concat('tool_', {SLUG}), example, 0.65, NULL, 0, 0, NULL, 'onet', 1, 0, NULL FROM tl
  UNION ALL SELECT soc_code, 'market_skill', skill_normalized, skill_name, imp, NULL, 0, 1, share_of_postings, source, 1, posting_count, NULL FROM di WHERE region = 'india'
  UNION ALL SELECT soc_code, 'market_skill', skill_normalized, skill_name, 0.5, NULL, 0, 1, NULL, 'curated', 1, 0, NULL FROM (VALUES ('15-2050.00', 'python', 'Python'), ('29-1140.00', 'nursing', 'General Nursing'), ('35-1010.00', 'excel', 'Advanced Excel')) AS v(soc_code, skill_normalized, skill_name)),
unified AS (SELECT soc_code, item_type, min(item_id) AS item_id, item_name, max(imp)::DOUBLE AS importance_norm, max(lvl)::DOUBLE AS level_norm, max(hot) AS hot_technology, max(dem) AS in_demand, max(share) AS india_demand_share,
  min(source) AS source, max(rel) AS reliable, CAST(max(pc) AS BIGINT) AS posting_count, CASE WHEN count(reason) > 0 THEN 0 ELSE 1 END AS india_relevant FROM u GROUP BY soc_code, item_type, item_name)"""

# A group that mixes relevant and irrelevant rows is irrelevant, as the smallest flag decides.


@query("u02_unified_requirements", f"WITH {REQ_SQL} SELECT * FROM unified")
def _(spark, sf):
    return requirements(spark, sf).drop("item_description", "soc_posting_total", "india_irrelevant_reason")


@query("a09_requirement_dedupe", f"WITH {REQ_SQL} SELECT soc_code, item_type, item_name, importance_norm, reliable FROM unified WHERE item_type IN ('tech', 'tool', 'task')")
def _(spark, sf):
    return requirements(spark, sf).where("item_type IN ('tech', 'tool', 'task')").select("soc_code", "item_type", "item_name", "importance_norm", "reliable")


@query("a22_counts_by_type", f"""
WITH {REQ_SQL} SELECT soc_code, count(*) AS total, count(*) FILTER (item_type = 'skill') AS skill, count(*) FILTER (item_type = 'knowledge') AS knowledge, count(*) FILTER (item_type = 'ability') AS ability,
  count(*) FILTER (item_type = 'work_activity') AS work_activity, count(*) FILTER (item_type = 'task') AS task, count(*) FILTER (item_type = 'dwa') AS dwa, count(*) FILTER (item_type = 'tech') AS tech,
  count(*) FILTER (item_type = 'tool') AS tool, count(*) FILTER (item_type = 'market_skill') AS market_skill FROM unified GROUP BY soc_code""")
def _(spark, sf):
    return req.counts_by_type(requirements(spark, sf))


@query("p13_local_relevance", f"SELECT task_id, {REASON.replace(chr(39) + 'R' + chr(39), chr(39) + req.RESERVED_REASON + chr(39)).replace(chr(39) + 'F' + chr(39), chr(39) + req.FOREIGN_REASON + chr(39))} AS reason FROM tasks")
def _(spark, sf):
    return lens(spark, sf, "tasks").select("task_id", req.irrelevance_reason(F.col("soc_code"), F.col("task_description"), foreign=True, reserved_codes=RESERVED).alias("reason"))


@query("p16_requirements_by_code", f"""
WITH {REQ_SQL} SELECT soc_code, item_type, item_name, importance_norm FROM unified WHERE soc_code IN ('15-2050.00', '29-1140.00') AND item_type = 'tech'""")
def _(spark, sf):
    return req.requirements_of(requirements(spark, sf), ["15-2050", "29-1140.00"], item_type="tech").select("soc_code", "item_type", "item_name", "importance_norm")


@query("t05_top_requirements", f"""
WITH {REQ_SQL} SELECT soc_code, item_type, item_name, i AS position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY soc_code ORDER BY coalesce(importance_norm, 0) DESC, item_type, item_name) AS INT) AS i FROM unified) WHERE i <= 12""")
def _(spark, sf):
    order = [F.desc(F.coalesce("importance_norm", F.lit(0.0))), F.asc("item_type"), F.asc("item_name")]
    return ranks.top_k(requirements(spark, sf), ["soc_code"], order, 12).select("soc_code", "item_type", "item_name", "position")


@query("t10_skills_and_technologies", f"""
WITH {WIDE_SQL}, te AS ({TECH}) SELECT soc_code, 'skill' AS kind, element_name AS name, CAST(i AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY importance DESC, element_name) AS i FROM rated) WHERE i <= 4
UNION ALL SELECT soc_code, 'technology', concat(example, '/', commodity_title), CAST(i AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY hot_technology DESC, in_demand DESC, example, commodity_title) AS i FROM te) WHERE i <= 10""")
def _(spark, sf):
    skills = ranks.top_k(req.element_ratings(lens(spark, sf, "ratings")), ["soc_code"], [F.desc("importance"), F.asc("element_name")], 4)
    tech = ranks.top_k(lens(spark, sf, TECH), ["soc_code"], [F.desc("hot_technology"), F.desc("in_demand"), F.asc("example"), F.asc("commodity_title")], 10)
    return skills.select("soc_code", F.lit("skill").alias("kind"), F.col("element_name").alias("name"), "position").unionByName(
        tech.select("soc_code", F.lit("technology").alias("kind"), F.concat_ws("/", "example", "commodity_title").alias("name"), "position"))


@query("t14_hot_technologies_core_tasks", f"""
WITH te AS ({TECH}) SELECT soc_code, example AS name FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY in_demand DESC, example, commodity_title) AS i FROM te WHERE hot_technology = 1) WHERE i <= 5
UNION ALL SELECT soc_code, task_id FROM (SELECT *, row_number() OVER (PARTITION BY soc_code ORDER BY importance DESC, load_id) AS i FROM tasks WHERE importance >= 30) WHERE i <= 5""")
def _(spark, sf):
    tech = ranks.top_k(lens(spark, sf, TECH).where("hot_technology = 1"), ["soc_code"], [F.desc("in_demand"), F.asc("example"), F.asc("commodity_title")], 5)
    tasks = ranks.top_k(lens(spark, sf, "tasks").where("importance >= 30"), ["soc_code"], [F.desc("importance"), F.asc("load_id")], 5)
    return tech.select("soc_code", F.col("example").alias("name")).unionByName(tasks.select("soc_code", F.col("task_id").alias("name")))


@query("j10_occupation_profiles", f"""
WITH e AS ({EDU}), m AS ({edu_map_sql()}), z AS ({ZONES}), r AS ({_vc(ZONE_REF)}),
x AS (SELECT e.soc_code, count(*) AS n_education, arg_max(m.local_level, {{'p': percent, 'c': -e.category}}) AS top_level, arg_max(e.category, {{'p': percent, 'c': -e.category}}) AS top_cat FROM e LEFT JOIN m USING (category) GROUP BY ALL),
tl AS (SELECT e.soc_code, m.local_level FROM e JOIN x ON x.soc_code = e.soc_code AND x.top_cat = e.category LEFT JOIN m ON m.category = e.category)
SELECT o.soc_code, substr(o.soc_code, 1, 2) AS soc_major_group, z.job_zone, r.zone_name, x.n_education, tl.local_level AS primary_qualification, rc.n AS n_related FROM occupations o
LEFT JOIN z USING (soc_code) LEFT JOIN r USING (job_zone) LEFT JOIN x ON x.soc_code = o.soc_code LEFT JOIN tl ON tl.soc_code = o.soc_code LEFT JOIN (SELECT soc_code, least(count(*), 10) AS n FROM ({RELATED}) GROUP BY soc_code) rc ON rc.soc_code = o.soc_code""")
def _(spark, sf):
    from .queries_facts import coded_postings

    occ = lens(spark, sf, "occupations")
    zones = req.with_zone_text(lens(spark, sf, ZONES), lens(spark, sf, ZONE_REF))
    edu = req.education_levels(lens(spark, sf, EDU).withColumn("percent", F.col("percent").cast("double")), lens(spark, sf, EDU_CAT), local_education(spark))
    exp = facts.experience_by_code(lens(spark, sf, "postings"), zones)
    profiles = req.occupation_profiles(occ, zones=zones, education=edu, experience=exp, salaries=facts.salary_cube(coded_postings(spark, sf)), related=lens(spark, sf, RELATED))
    return profiles.select("soc_code", "domain.soc_major_group", "job_zone", "zone_name", F.size("education").cast("long").alias("n_education"), "primary_qualification",
                           F.size("related").cast("long").alias("n_related"))
