import random

import pytest
from pyspark.sql import functions as F

from laborcast.operators import best_matches as bm, matching as mt
from laborcast.sources import seeds

NOW = "2024-05-01 00:00:00"


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(3)
    skills, _ = seeds.taxonomy(spark)
    ids = [s[0] for s in seeds.SKILLS]
    modes, types = ["remote", "hybrid", "onsite", "unknown"], ["full_time", "contract", "unknown"]
    texts = ["", "needs python and machine learning", "Master's degree", None]
    jobs, asked = [], []
    for i in range(700):
        role, city = ("nurse", "Pune") if rng.random() < .5 else (rng.choice(["nurse", "chef"]), rng.choice(["Delhi", "Noida", "Pune", None]))
        pay = rng.choice([None, rng.randint(3, 40) * 100_000])
        jobs.append((i, rng.choice(["Senior Nurse", "Chef", "Intern", "Data Engineer II"]), role, city, rng.choice(modes), rng.choice(types), rng.choice([None, 1.0, 4.0]), None,
                     pay, pay and pay + 200_000, rng.random() < .1, rng.random() < .2, f"2024-0{rng.randint(1, 4)}-{rng.randint(1, 28):02} 00:00:00" if rng.random() < .9 else None, rng.choice(texts)))
        for s in set(rng.choices(ids, k=rng.choice([0, 1, 4, 8]))):
            asked.append((i, role, s, rng.random() < .3))
    people = [(c, float(rng.randint(0, 15)), rng.choice([[], ["B.Tech"], ["Master of Science"]]), [rng.choice(["Pune", "Delhi"])]) for c in range(60)]
    held = [(c, s, rng.randint(0, 4), rng.random() < .2) for c in range(55) for s in set(rng.choices(ids, k=rng.randint(1, 12)))]
    requests = [(c, rng.choice(["nurse", "chef", "pilot"]), rng.choice(["Pune", "Delhi", "Noida", None])) for c in range(60) for _ in range(2)]
    job_rows = spark.createDataFrame(jobs, "job_id int, title string, role string, location string, work_mode string, employment_type string, experience_min double, experience_max double, "
                                     "salary_min long, salary_max long, salary_is_predicted boolean, stale boolean, posted_at string, description string").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    return {
        "jobs": job_rows, "people": spark.createDataFrame(people, "candidate_id int, experience_years double, education array<string>, cities array<string>"),
        "requests": spark.createDataFrame(requests, "candidate_id int, role string, city string"),
        "lists": mt.job_lists(job_rows, spark.createDataFrame(asked, "job_id int, role string, skill_id string, inferred boolean"), skills, mt.is_broad(F.col("skill_id"))),
        "credits": mt.credit_maps(spark.createDataFrame(held, "candidate_id int, skill_id string, level int, needs_verification boolean"), skills),
    }


WISHES = {"work_modes": ["remote"], "employment_types": ["full_time"], "min_lpa": 12.0}


def by_role():
    return {"median": F.when(F.col("role") == "nurse", 900_000), "now": F.lit(NOW).cast("timestamp")}


@pytest.mark.parametrize("k,first,blocks", [(5, None, 1000), (3, 3, 7), (400, None, 50)])
def test_best_jobs_equal_those_of_all_pairs(market, monkeypatch, k, first, blocks):
    monkeypatch.setattr(bm, "JOBS_PER_BLOCK", blocks)
    m = market
    best = bm.best_market_jobs(m["requests"], m["jobs"], m["lists"], m["people"], m["credits"], **by_role(), k=k, first=first, **WISHES)
    got = {(r.candidate_id, r.position): (r.job_id, r.rank_score, r.matched) for r in best.collect()}
    pairs = bm.market_pairs(m["requests"], m["jobs"])
    whole = mt.rank_jobs(mt.match_pairs(mt.pair_scores(pairs, m["lists"], m["credits"]), m["jobs"], m["people"], **WISHES), *by_role().values(), k=k)
    assert got == {(r.candidate_id, r.position): (r.job_id, r.rank_score, r.matched) for r in whole.collect()} and len(got) > 100


def test_bounds_cut_pairs_and_are_never_exceeded(market):
    m = market
    classes = bm.job_classes(m["jobs"], m["lists"], **by_role(), **WISHES)
    bounds = bm.class_bounds(m["requests"].distinct(), classes, m["people"])
    pairs = bm.market_pairs(m["requests"], m["jobs"])
    ranked = mt.rank_jobs(mt.match_pairs(mt.pair_scores(pairs, m["lists"], m["credits"]), m["jobs"], m["people"], **WISHES), *by_role().values())
    met = ranked.join(classes.select("job_id", "class"), "job_id").join(bounds.select("candidate_id", "class", "bound"), ["candidate_id", "class"])
    assert met.count() == pairs.count() and met.where("rank_score > bound").count() == 0
    heads = classes.limit(0).select("job_id")
    able = lambda least: bm.hopeful_pairs(bounds.withColumn("least", F.lit(least)).withColumn("opened", F.lit(False)), classes, heads).count()
    assert able(0.0) == pairs.count() and 0 < able(0.75) < 0.7 * pairs.count()


def test_jobs_without_skills_are_scored_by_their_text(spark):
    skills, _ = seeds.taxonomy(spark)
    jobs = spark.createDataFrame([(1, "Engineer", "knows Machine Learning, c++ and sql"), (2, "SQL admin", None), (3, "x", "mysqlite")], "job_id int, title string, description string")
    none = spark.createDataFrame([], "job_id int, role string, skill_id string, inferred boolean")
    held = spark.createDataFrame([(7, "machine_learning", 3, False), (7, "sql", 1, False), (7, "docker", 2, False)], "candidate_id int, skill_id string, level int, needs_verification boolean")
    pairs = spark.createDataFrame([(c, j) for c in (7, 8) for j in (1, 2, 3)], "candidate_id int, job_id int")
    scored = mt.pair_scores(pairs, mt.job_lists(jobs, none, skills, mt.is_broad(F.col("skill_id"))), mt.credit_maps(held, skills))
    got = {(r.candidate_id, r.job_id): (round(r.skills, 4), r.matched, r.missing) for r in scored.collect()}
    assert got == {(7, 1): (0.6667, ["machine_learning", "sql"], []), (7, 2): (0.3333, ["sql"], []), (7, 3): (0.0, [], []), **{(8, j): (0.0, [], []) for j in (1, 2, 3)}}


def test_pairs_never_become_rows_outside_a_block(market, monkeypatch):
    # Only what can be among a candidate's best leaves a block; before, all classes of a market were rows of each candidate.
    sent = []
    scored = mt.scored_matches
    monkeypatch.setattr(mt, "scored_matches", lambda pairs, *a, **k: sent.append(pairs) or scored(pairs, *a, **k))
    m = market
    bm.best_market_jobs(m["requests"], m["jobs"], m["lists"], m["people"], m["credits"], **by_role(), k=3, **WISHES)
    whole, left = bm.market_pairs(m["requests"], m["jobs"]).count(), sent[0].count()
    assert 0 < left < whole / 10


def test_matches_in_one_row_equal_those_of_joined_parts(market, spark):
    m = market
    pairs = bm.market_pairs(m["requests"], m["jobs"])
    parts = mt.match_pairs(mt.pair_scores(pairs, m["lists"], m["credits"]), m["jobs"], m["people"], **WISHES)
    got = mt.scored_matches(pairs, m["jobs"], m["lists"], m["people"], m["credits"], **WISHES)
    columns = ["candidate_id", "job_id", "skills", "experience", "education_match", "location_match", "seniority", "preference", "overall", "matched", "missing"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, parts.select(columns).collect()))
    texts = got._jdf.queryExecution().optimizedPlan().toString()
    assert texts.index("RLIKE") > texts.index("Join")  # texts are read below the join with the pairs


def test_unlocked_jobs_equal_those_of_skill_rows(spark):
    rng = random.Random(5)
    skills, _ = seeds.taxonomy(spark)
    ids = [s[0] for s in seeds.SKILLS][:25]
    jobs = spark.createDataFrame([(i, "Engineer", "nurse", "Pune", "unknown", "unknown", 1.0, 9.0, None, None, False, "") for i in range(60)],
                                 "job_id int, title string, role string, location string, work_mode string, employment_type string, experience_min double, experience_max double, "
                                 "salary_min long, salary_max long, salary_is_predicted boolean, description string")
    asked = spark.createDataFrame([(i, "nurse", s, rng.random() < .3) for i in range(55) for s in set(rng.choices(ids, k=5))], "job_id int, role string, skill_id string, inferred boolean")
    held = spark.createDataFrame([(c, s, rng.randint(0, 4), rng.random() < .2) for c in range(20) for s in set(rng.choices(ids, k=6))], "candidate_id int, skill_id string, level int, needs_verification boolean")
    people = spark.createDataFrame([(c, 4.0, [], ["Pune"]) for c in range(22)], "candidate_id int, experience_years double, education array<string>, cities array<string>")
    wanted = spark.createDataFrame([(c, s) for c in range(22) for s in set(rng.choices(ids, k=3))], "candidate_id int, skill_id string")
    pairs, broad = spark.range(22).selectExpr("int(id) AS candidate_id").crossJoin(jobs.select("job_id")), mt.is_broad(F.col("skill_id"))
    rows = mt.skill_rows(pairs, asked, mt.skill_credits(held, skills), skills, broad)
    slow = mt.skill_unlocks(mt.match_pairs(mt.skill_scores(rows), jobs, people), rows, wanted)
    fast = mt.unlocked_jobs(pairs, jobs, mt.item_lists(asked, skills, broad), people, mt.credit_maps(held, skills), wanted)
    assert {tuple(r) for r in fast.collect()} == {tuple(r) for r in slow.collect()} and slow.count() > 5


def test_patterns_are_made_only_of_names_in_the_text(spark):
    rows = spark.createDataFrame([("knows machine learning, c++ and sql", ["machine_learning", "sql", "docker", "c++", "machine"]), ("mysqlite", ["sql"]), (None, ["sql"])], "text string, top array<string>")
    found = rows.select(F.filter("top", lambda s: mt.in_text(F.col("text"), s)).alias("f"))
    assert [r.f for r in found.collect()] == [["machine_learning", "sql", "machine"], [], []]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.lower().find("contains(") < plan.index("RLIKE")


def test_what_depends_on_the_job_alone_comes_with_it(market):
    lists = {r.job_id: r for r in market["lists"].collect()}
    assert {r["items"] is None for r in lists.values()} == {r["_w"] is None for r in lists.values()}
    for r in lists.values():
        if r["items"] is not None:
            assert r["_w"] == sum(x["w"] for x in r["items"]) and r["_inferred"] == sum(x["inferred"] for x in r["items"]) / len(r["items"])
