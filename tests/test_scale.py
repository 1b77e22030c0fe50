"""Steps that must not grow faster than their input, on rows built here."""
import numpy as np
from pyspark.sql import functions as F

from laborcast.operators import gap, matching as mt, vectors as vec
from laborcast.plans import queries_text
from laborcast.plans.lenses import lens


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_resume_texts_are_never_broadcast(spark, tmp_path):
    spark.range(6).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(10.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")) \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"),
                          F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries_text.resumes(spark, str(tmp_path))
    assert "SortMergeJoin" in plan(rows)
    texts = {r.candidate_id: r.text for r in rows.collect()}
    assert sorted(texts) == list(range(6)) and all(f"\ntext {c % 4}\n" in t for c, t in texts.items())


def test_gap_rows_shuffle_profiles_only(spark):
    required = spark.createDataFrame([("r", s, s, True, i, 1.0, 3, "High") for i, s in enumerate(["sql", "python", "go"])],
                                     "target_role string, skill_id string, display string, in_taxonomy boolean, position int, importance double, required_level int, priority string")
    profile = spark.createDataFrame([(1, "mysql", 2, 0.9, False, True, 2), (1, "pg", 3, 0.5, True, False, 3), (1, "python", 1, 0.4, False, True, None), (None, "go", 3, 0.9, False, True, None)],
                                    "candidate_id int, skill_id string, level int, confidence double, needs_verification boolean, supported boolean, claimed int")
    relations = spark.createDataFrame([("sql", "mysql", 2), ("sql", "pg", 2), ("go", "python", 4)], "required_id string, have_id string, rule int")
    people = spark.createDataFrame([(1, "r"), (1, "r"), (2, "r"), (None, "r"), (3, None)], "candidate_id int, target_role string")
    rows = gap.gap_rows(people, required, profile, relations)
    got = sorted((r.candidate_id or 0, r.skill_id, r.status, r.via, r.via_claimed) for r in rows.collect())
    none = [(c, s, "missing", None, None) for c in (0, 2) for s in ("go", "python", "sql")]
    assert got == sorted(none + 2 * [(1, "sql", "matched", "pg", 3), (1, "python", "matched", "python", None), (1, "go", "adjacent", "python", None)], key=lambda r: r[:2])
    # The rows stay where their candidate is: nothing that is grouped by candidate moves them again.
    grouped = rows.groupBy("candidate_id", "target_role").agg(F.count("status"))
    after = plan(grouped)
    assert "Exchange hashpartitioning" not in after[:after.index("Generate")]


def test_unlike_vectors_with_a_key_in_common_leave_no_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    sides = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>") for x in (base, base + 0.1 * rng.standard_normal(base.shape))]
    found = vec.similar_classes(*[vec.classes(s, "k", "v") for s in sides], 32, threshold=0.82, bits=4, recall=0.999)
    assert {(r.left, r.right) for r in found.collect()} >= {(i, i) for i in range(300)}
    # With four signs a key nearly all 90,000 pairs share one; the count of equal signs is tested in their join.
    assert vec.least_agreement(0.82, 320) > 220 and "bit_count" in plan(found)


def _market(spark):
    skills = spark.createDataFrame([("sql", "data", False), ("mysql", "sql", False), ("data", None, True)], "id string, maps_to string, is_category boolean")
    asked = spark.createDataFrame([(1, "sql", False), (1, "mysql", True), (1, "data", False), (1, "tally", False), (1, "tally", False), (1, None, None), (2, "mysql", False),
                                   (3, "gone", None), (3, "tally", True)], "job_id int, skill_id string, inferred boolean")
    held = spark.createDataFrame([(7, "mysql", 3, False), (7, "tally", 1, True), (7, None, 3, False), (8, "sql", 2, False), (8, "data", 0, False), (None, "sql", 3, False)],
                                 "candidate_id int, skill_id string, level int, needs_verification boolean")
    pairs = spark.createDataFrame([(c, j) for c in (7, 8, 9, None) for j in (1, 2, 3, 4, None)] + [(7, 1)], "candidate_id int, job_id int")
    jobs = spark.createDataFrame([(1, "a", "b"), (2, "c", None), (3, None, None), (4, "my sql job", "mysql and tally")], "job_id int, title string, description string")
    return skills, asked, held, pairs, jobs, mt.is_broad(F.col("skill_id"))


def test_pairs_with_places_score_like_pairs_with_names(spark):
    skills, asked, held, pairs, jobs, broad = _market(spark)
    lists, credits = mt.job_lists(jobs, asked, skills, broad), mt.credit_maps(held.where("skill_id IS NOT NULL"), skills)
    known = mt.known_items(skills)
    assert known == (("data", None), ("mysql", "sql"), ("sql", "data"))
    rows = lambda df: sorted(map(str, df.collect()))
    named = mt.pair_scores(pairs, lists, credits)
    for some in (known, known[:1], (("sql", None),)):
        assert rows(mt.pair_scores(pairs, lists, credits, known=some)) == rows(named)
    # What pairs carry to their candidates has no names of known skills.
    assert mt.with_places(lists.where("job_id = 2"), known).select("_others").first()[0] is None
    direct = mt.skill_credits(held, skills)
    by_name = mt.skill_rows(pairs, asked, direct, skills, broad)
    assert by_name.count() == 3 * (6 + 1 + 2) + 6 + 9 and rows(mt.skill_rows(pairs, asked, direct, skills, broad, known=known)) == rows(by_name)
    assert "candidate_id, parent" not in plan(by_name) and "skill_id, candidate_id" not in plan(by_name)


def test_lines_are_dealt_once_for_what_is_grouped_by_their_job_or_candidate(spark, tmp_path):
    spark.range(40).select((F.col("id") % 9).alias("l_orderkey"), (F.col("id") * 7 % 50).alias("l_partkey"), (F.col("id") % 7).cast("int").alias("l_linenumber")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    for name, key in (("applications", "job_id"), ("posting_skills", "posting_id"), ("candidate_evidence", "candidate_id"), ("candidate_claims", "candidate_id")):
        rows = lens(spark, str(tmp_path), name)
        assert rows.count() == rows.distinct().count() > 0
        assert plan(rows.groupBy(key).agg(F.count(F.lit(1)))).count("Exchange hashpartitioning") == 1
