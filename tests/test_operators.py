"""Operators against brute force and known worked figures on small fixtures."""
import random
import re

import pytest
from pyspark.sql import functions as F

from laborcast.operators import containment, gap, matching as mt, ranks, roadmap, salary as sal, taxonomy as tax, textmine
from laborcast.sources import seeds


def test_percentile_rules_match_brute_force(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"g{i % 5}", rnd.choice([-5.0, 0.0, 1e-9, 2.5, 1023.999, 1024.0]) if i % 2 else rnd.uniform(-1e6, 1e6)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    floor = {r["g"]: r for r in ranks.floor_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    linear = {r["g"]: r for r in ranks.linear_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    for g in {r[0] for r in rows}:
        s = sorted(v for k, v in rows if k == g)
        assert [floor[g][c] for c in "abc"] == [s[int(len(s) * q)] for q in (0.25, 0.5, 0.75)]
        for name, q in (("a", 0.25), ("b", 0.9)):
            pos = (len(s) - 1) * q
            lo = int(pos)
            assert linear[g][name] == pytest.approx(s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (pos - lo))


def test_rank_positions_match_brute_force(spark):
    rows = [(i % 2, float((i * 37) % 50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, score double, id int")
    got = {(r["g"], r["id"]): r["rank"] for r in ranks.dense_rank_positions(df, ["g"], "score", ["id"]).collect()}
    for g in (0, 1):
        for i, (_, _, rid) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), start=1):
            assert got[(g, rid)] == i


def test_containment_matches_brute_force(spark):
    words = ["ab", "abc", "data", "data eng", "engineer", "x", "senior data engineer", "eng", "zzz", "a"]
    texts = ["senior data engineer", "data entry", "ab", "xylophone", "engineering", "", "abcabc"]
    p, t = spark.createDataFrame([(w,) for w in words], "p string"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = {(r["p"], r["t"]) for r in containment.contains_join(p, "p", t, "t").collect()}
    assert got == {(a, b) for a in words for b in texts if a in b}


def test_gap_score_relations(spark):
    skills, aliases = seeds.taxonomy(spark)
    closure = tax.ancestors(skills)
    assert {(r["ancestor"], r["depth"]) for r in closure.where("id = 'postgresql'").collect()} == {("sql", 1), ("databases", 2), ("data", 3)}
    required = gap.with_importance(spark.createDataFrame(
        [("r", s, s, True, w, i) for i, (s, w) in enumerate([("python", None), ("sql", None), ("mysql", 0.9), ("kubernetes", None), ("tableau", None)])],
        "target_role string, skill_id string, display string, in_taxonomy boolean, weight double, position int"))
    weights = {r["skill_id"]: (round(r["importance"], 4), r["required_level"]) for r in required.collect()}
    assert weights["python"] == (1.0, 3) and weights["sql"] == (0.8696, 3) and weights["mysql"] == (0.9, 4) and weights["kubernetes"] == (0.6897, 2)
    profile = spark.createDataFrame([(1, "python", 3, 0.9, True, False), (1, "postgresql", 2, 0.75, True, False), (1, "docker", 2, 0.75, True, False)],
                                    "candidate_id int, skill_id string, level int, confidence double, supported boolean, needs_verification boolean")
    people = spark.createDataFrame([(1, "r")], "candidate_id int, target_role string")
    rows = gap.gap_rows(people, required, profile, gap.skill_relations(skills, closure))
    got = {r["skill_id"]: (r["status"], r["via"]) for r in rows.collect()}
    assert got == {"python": ("matched", "python"), "sql": ("matched", "postgresql"), "mysql": ("adjacent", "postgresql"),
                   "kubernetes": ("adjacent", "docker"), "tableau": ("adjacent", "postgresql")}
    scored = gap.gap_scores(rows, people.withColumn("experience_years", F.lit(1.0)).withColumn("role_min", F.lit(0.0)).withColumn("role_max", F.lit(5.0))).first()
    w = [1.0, 1 / 1.15, 0.9, 1 / 1.45, 1 / 1.6]
    coverage = (w[0] + w[1] * 2 / 3 + 0.4 * (w[2] + w[3] + w[4])) / sum(w)
    assert scored["coverage"] == pytest.approx(coverage)
    assert scored["match_score"] == pytest.approx(round(0.85 * coverage + 0.15, 4))


def test_roadmap_puts_prerequisites_first(spark):
    skills, _ = seeds.taxonomy(spark)
    gaps = spark.createDataFrame([(1, "r", "deep_learning", "missing", 2, 0.9, 0), (1, "r", "kubernetes", "missing", 2, 0.5, 1), (1, "r", "ai", "missing", 2, 1.0, 2)],
                                 "candidate_id int, target_role string, skill_id string, status string, gap int, importance double, position int")
    profile = spark.createDataFrame([(1, "linux"), (1, "pandas")], "candidate_id int, skill_id string")
    items = roadmap.roadmap_items(gaps, profile, skills, tax.ancestors(skills))
    got = [(r["skill_id"], r["kind"], r["hours_low"], r["weeks_high"]) for r in roadmap.ordered_roadmap(items, skills, hours_per_week=10.0).orderBy("order").collect()]
    # pandas implies python, so only statistics and machine learning are pulled in; ai is a field, not a milestone.
    assert [g[:2] for g in got] == [("statistics", "prerequisite"), ("machine_learning", "prerequisite"), ("deep_learning", "missing"),
                                    ("docker", "prerequisite"), ("kubernetes", "missing")]
    assert [g[3] for g in got] == [6, 18, 30, 36, 48]


def _reference_hits(text, aliases):
    """Plain regular expressions over one text, longest match first."""
    spans = []
    for order, (sid, alias) in enumerate(aliases):
        body = r"[\s\-_]{0,2}".join(re.escape(p) for p in re.split(r"[\s\-_]+", alias) if p)
        spans += [(m.end() - m.start(), m.start(), m.end(), sid, m.group()) for m in re.finditer(rf"(?<![\w+#&.])(?:{body})(?![\w+#&])", text, re.I)]
    kept = []
    for s in sorted(spans, key=lambda s: (-s[0], s[1])):
        if not any(s[1] < k[2] and k[1] < s[2] for k in kept):
            kept.append(s)
    return sorted((k[3], k[4]) for k in kept)


def test_extraction_matches_plain_regular_expressions(spark):
    skills, _ = seeds.taxonomy(spark)
    plain = [(s[0], a) for s in seeds.SKILLS for a in s[7] if a not in seeds.AMBIGUOUS_ALIASES]
    aliases = spark.createDataFrame([(i, a, None) for i, a in plain], "id string, alias string, rule string")
    texts = ["Python, SQL and React Native; react.js too. Python.org, (Java)", "machine\nlearning or machine-learning, MACHINE_LEARNING machinelearning",
             "deep  learning deep   learning", "C++ not C# nor R&D; Node.js. node.js! .python a.python", "Google\n\nCloud google\n \ncloud k8s,docker/linux",
             "power bi_power-bi Amazon Web Services", "ML-ops ml. (ml) éml mlé generative ai", "\n\n\nsql\n", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hits = textmine.skill_hits(docs, "id", "text", skills, aliases).collect()
    for i, text in enumerate(texts):
        assert sorted((h["skill_id"], h["surface"]) for h in hits if h["id"] == i) == _reference_hits(text, plain), text


def test_ambiguous_aliases_need_context(spark):
    skills, aliases = seeds.taxonomy(spark)
    texts = ["Skills: Python, Go, SQL", "let us go home", "We write Go daily", "Go home", "C", "languages: C / R"]
    docs = spark.createDataFrame([(i, t, i == 4) for i, t in enumerate(texts)], "id int, text string, ctx boolean")
    hits = textmine.skill_hits(docs, "id", "text", skills, aliases, skills_context=F.col("ctx"))
    got = {i: set() for i in range(len(texts))}
    for r in hits.collect():
        got[r["id"]].add(r["skill_id"])
    assert got == {0: {"python", "go", "sql"}, 1: set(), 2: {"go"}, 3: set(), 4: {"c"}, 5: {"c", "r"}}


def test_sections_history_and_education(spark):
    text = ("Asha\nEXPERIENCE\nData Analyst, Swiggy  Jan 2020 - Mar 2022\nUsed SQL\nAcme Corp\nSoftware Intern 06/2019 to 12/2019\n"
            "Skills:\nSKILLS\nPython, Go\nEducation\nB.Tech in Computer Science, IIT Delhi\n2015 - 2019\n")
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    parts = textmine.sections(docs, "id", "text")
    bodies = {r["section"]: r["body"] for r in parts.collect()}
    assert set(bodies) == {"header", "experience", "skills", "education"} and bodies["skills"] == "Python, Go"
    jobs = textmine.work_history(parts.where("section = 'experience'"), "id", "body", today=F.lit("2024-01-15").cast("date"))
    got = {(r["title"], r["company"], r["start_month"], r["end_month"], r["internship"]) for r in jobs.collect()}
    assert got == {("Data Analyst", "Swiggy", 2020 * 12, 2022 * 12 + 2, False), ("Software Intern", "Acme Corp", 2019 * 12 + 5, 2019 * 12 + 11, True)}
    school = textmine.education(parts.where("section = 'education'"), "id", "body").first()
    assert (school["degree"], school["field"], school["institution"], school["year"]) == ("B.Tech", "Computer Science", "IIT Delhi", 2019)


def test_merged_years_counts_overlaps_once(spark):
    rows = spark.createDataFrame([(1, 0, 11), (1, 6, 17), (1, 18, 23), (1, 40, 45)], "k int, start_month int, end_month int")
    assert textmine.merged_years(rows, ["k"]).first()["years"] == 2.5


def test_misread_repair(spark):
    skills, aliases = seeds.taxonomy(spark)
    docs = spark.createDataFrame([(1, "Used Power Bl and Hado0p, also Python")], "id int, text string")
    assert {(r["raw"], r["fixed"]) for r in tax.misread_repairs(docs, "id", "text", skills, aliases).collect()} == {("Power Bl", "Power BI"), ("Hado0p", "Hadoop")}


def test_gram_similarity_finds_every_pair(spark):
    import math
    left, right = ["machine learning", "postgresql db", "docker"], ["machine learning", "machine learnings", "postgresql", "dockers", "go"]
    rows = [("g", "left", n) for n in left] + [("g", "right", n) for n in right]
    df = spark.createDataFrame(rows, "g string, side string, name string")
    got = {(r["left_name"], r["right_name"]): r["similarity"] for r in tax.gram_similarity(df, ["g"], threshold=0.6).collect()}

    def grams(n):
        return [f" {w} "[i:i + 3] for w in n.split() for i in range(len(w))]

    docs = [(s, n) for _, s, n in rows]
    df_count = {}
    for _, n in docs:
        for g in set(grams(n)):
            df_count[g] = df_count.get(g, 0) + 1

    def vec(n):
        v = {g: grams(n).count(g) * (math.log((1 + len(docs)) / (1 + df_count[g])) + 1) for g in set(grams(n))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    want = {}
    for a in left:
        for b in right:
            s = sum(x * vec(b).get(g, 0.0) for g, x in vec(a).items())
            if s >= 0.6:
                want[(a, b)] = s
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_salary_figures(spark):
    hist = spark.createDataFrame([("r", b, v) for b, v in [(0, 117), (1000000, 191), (2000000, 88), (3000000, 33), (4000000, 12), (5000000, 5), (6000000, 0)]],
                                 "role string, bound long, vacancies int")
    row = sal.histogram_estimate(hist, ["role"]).first()
    assert (row["estimated_min"], row["estimated_median"], row["estimated_max"], row["sample_size"]) == (500000, 1500000, 2500000, 446)
    base = sal.baseline_estimate(spark.createDataFrame([("r", 18.5)], "role string, median_lpa double"), ["role"]).first()
    assert (base["estimated_min"], base["estimated_median"], base["estimated_max"]) == (1390000, 1850000, 2310000)
    jobs = spark.createDataFrame([("r", v, v, False) for v in (1200000, 1400000, 1500000, 1700000, 1800000, 2000000, 9000000)]
                                 + [("r", None, None, False), ("r", 400000, 2500000, False), ("r", 1000000, 1200000, True)],
                                 "role string, salary_min long, salary_max long, salary_is_predicted boolean")
    counts = {r["reason"]: r["rows"] for r in sal.exclusion_counts(jobs, ["role"]).collect()}
    assert counts == {"no_salary": 1, "predicted": 1, "wide_range": 1, "outlier": 1}
    est = sal.posted_estimate(jobs, ["role"]).first()
    assert (est["sample_size"], est["confidence"]) == (6, 0.63)


def test_two_source_check(spark):
    pct = spark.createDataFrame([(1, 1e6, 2e6, 3e6, 100), (2, 1e6, 2e6, 3e6, 100)], "k int, p25 double, p50 double, p75 double, sample_size int")
    ext = spark.createDataFrame([(1, 1e6, 1.81e6, 3e6, 900, "HIGH"), (2, 8e5, 1.086e6, 2e6, 900, "HIGH")], "k int, min double, median double, max double, count long, label string")
    got = {r["k"]: (r["agree"], r["gap_pct"], r["primary"], r["confidence"]) for r in sal.two_source_estimate(pct, ext, ["k"]).collect()}
    assert got == {1: (True, -9.5, "market_percentiles", 0.65), 2: (False, -45.7, "external_estimate", 0.5)}


def test_match_components(spark):
    skills, _ = seeds.taxonomy(spark)
    jobs = spark.createDataFrame([(1, "Data Engineer", "r", "full_time", "onsite", "Pune", 3.0, None, "", None, None, False)],
                                 "job_id int, title string, role string, employment_type string, work_mode string, location string, experience_min double, experience_max double, "
                                 "description string, salary_min long, salary_max long, salary_is_predicted boolean")
    job_skills = spark.createDataFrame([(1, "r", s, False) for s in ("python", "sql", "postgresql", "docker")], "job_id int, role string, skill_id string, inferred boolean")
    held = spark.createDataFrame([(7, "python", 1, False), (7, "sql", 3, False)], "candidate_id int, skill_id string, level int, needs_verification boolean")
    pairs = spark.createDataFrame([(7, 1)], "candidate_id int, job_id int")
    rows = mt.skill_rows(pairs, job_skills, mt.skill_credits(held, skills), skills, mt.is_broad(F.col("skill_id")))
    scored = mt.skill_scores(rows)
    got = scored.first()
    assert got["skills"] == pytest.approx((0.6 + 1.0 + 0.5 + 0.0) / 4)
    assert (got["matched"], got["missing"]) == (["postgresql", "python", "sql"], ["docker"])
    people = spark.createDataFrame([(7, 2.0, ["B.Tech"], ["Pune"])], "candidate_id int, experience_years double, education array<string>, cities array<string>")
    m = mt.match_pairs(scored, jobs, people).first()
    assert m["experience"] == pytest.approx(2 / 3) and m["location_match"] == 1.0 and m["education_match"] == 1.0 and m["seniority"] == 1.0
    assert m["overall"] == pytest.approx(round(0.4 * 0.525 + 0.2 * 2 / 3 + 0.4, 4))
    unlocks = mt.skill_unlocks(mt.match_pairs(scored, jobs, people).withColumn("match_class", F.lit("Partial")), rows, spark.createDataFrame([(7, "docker")], "candidate_id int, skill_id string"))
    assert unlocks.first()["jobs_unlocked"] == 1


def _tiny_taxonomy(spark):
    skills = spark.createDataFrame([("c", "C", None, [], 1, False, 0), ("r", "R", None, [], 1, False, 1), ("lo", "Law of the sea", None, [], 1, False, 2)],
                                   "id string, display string, maps_to string, prerequisites array<string>, difficulty_tier int, is_category boolean, load_id int")
    aliases = spark.createDataFrame([("c", "c", "list"), ("r", "r", "list"), ("lo", "united nations law of the sea", None)], "id string, alias string, rule string")
    return skills, aliases


def test_list_rule_reads_at_the_mention_itself(spark):
    skills, aliases = _tiny_taxonomy(spark)
    docs = spark.createDataFrame([(1, "Tech stack: c, r"), (2, "Langs: c, r"), (3, "a c minor chord: d, e"), (4, "\n\nintro\n Tech: c ; r")], "id int, text string")
    got = {(h.id, h.skill_id) for h in textmine.skill_hits(docs, "id", "text", skills, aliases).collect()}
    assert got == {(1, "c"), (1, "r"), (2, "c"), (2, "r"), (4, "c"), (4, "r")}


def test_aliases_of_any_length_are_found(spark):
    skills, aliases = _tiny_taxonomy(spark)
    docs = spark.createDataFrame([(1, "knows United Nations law of the sea well")], "id int, text string")
    assert [h.surface for h in textmine.skill_hits(docs, "id", "text", skills, aliases).collect()] == ["United Nations law of the sea"]


def test_closures_follow_long_chains(spark):
    from laborcast.operators import taxonomy

    chain = spark.createDataFrame([(f"s{i}", f"s{i + 1}" if i < 40 else None) for i in range(41)], "id string, maps_to string")
    assert taxonomy.ancestors(chain).where("id = 's0'").count() == 40


def test_roadmap_says_what_it_leaves_out(spark):
    skills = spark.createDataFrame([(f"s{i}", [], 1) for i in range(20)], "id string, prerequisites array<string>, difficulty_tier int")
    items = spark.createDataFrame([(1, "role", f"s{i}", "missing", 1.0 / (i + 1), i, []) for i in range(20)],
                                  "candidate_id int, target_role string, skill_id string, kind string, importance double, position int, required_for array<string>")
    whole = roadmap.ordered_roadmap(items, skills).collect()
    short = roadmap.ordered_roadmap(items, skills, limit=15).collect()
    assert len(whole) == 20 and {r.omitted for r in whole} == {0} and {r.total_hours_low for r in whole} == {200}
    assert len(short) == 15 and {r.omitted for r in short} == {5} and {r.total_hours_low for r in short} == {150}


def test_a_donor_needs_skills(spark):
    from laborcast.operators import postings

    rows = [(1, "board", "Chef", "A", "Pune", "short", None, False, []), (2, "full", "Chef", "A", "Pune", "much longer text", None, False, []), (3, "full", "Chef", "A", "Pune", "longer text", None, False, ["x"])]
    jobs = spark.createDataFrame([r[:6] + (5, False) + (r[8],) if r[0] == 1 else r for r in rows], "job_id int, source string, title string, company string, location_raw string, description string, salary_min int, salary_is_predicted boolean, skills array<string>")
    options = {"source_order": ["board", "full"], "donor_source": "full"}
    assert postings.merge_duplicates(jobs, **options).first().skills_from == 2
    assert postings.merge_duplicates(jobs, has_skills=F.size("skills") > 0, **options).first().skills_from == 3


def test_learning_order_against_repeated_choice(spark):
    rng = random.Random(9)
    requests = []
    for c in range(120):
        ids = rng.sample([f"s{i}" for i in range(30)], rng.randint(1, 14))
        for s in ids:
            requests.append((c, "r", s, "missing", rng.choice([0.2, 0.5, 0.9, None]), rng.randint(0, 3), []))
    needs = {f"s{i}": [f"s{j}" for j in rng.sample(range(30), rng.randint(0, 4)) if j < i or rng.random() < .03] for i in range(30)}
    skills = spark.createDataFrame([(s, d, 1) for s, d in needs.items()], "id string, prerequisites array<string>, difficulty_tier int")
    items = spark.createDataFrame(requests, "candidate_id int, target_role string, skill_id string, kind string, importance double, position int, required_for array<string>")
    got: dict[int, list] = {}
    for r in roadmap.ordered_roadmap(items, skills).orderBy("candidate_id", "order").collect():
        got.setdefault(r.candidate_id, []).append(r.skill_id)
    for c in range(120):
        left = {r[2]: r for r in requests if r[0] == c}
        done = []
        while ready := [r for s, r in left.items() if s not in done and all(d in done for d in needs[s] if d in left)]:
            done.append(min(ready, key=lambda r: (r[4] is not None, -(r[4] or 0), r[5], r[2]))[2])
        assert got.get(c, []) == done


def test_closure_of_a_taxonomy_that_reads_a_cte_has_no_cte_inside_another(spark):
    # A CTE inside a recursive one is numbered twice, so that in a session's first query it was taken for another.
    skills = spark.sql("WITH s AS (SELECT * FROM (VALUES ('a', 'b'), ('b', 'c'), ('c', '')) AS t(id, maps_to)) SELECT s.* FROM s JOIN s t ON s.id = t.id")
    closure = tax.ancestors(skills)
    assert sorted(map(tuple, closure.collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert closure._jdf.queryExecution().analyzed().toString().count("WithCTE") == 1
