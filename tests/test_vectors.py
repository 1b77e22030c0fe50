import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborcast.operators import gap, vectors as vec
from laborcast.plans import queries_gap as q

SF = "/root/testdata/sf0.001"


def brute(a, b, threshold):
    x, y = (np.array([v for _, v in s], dtype=float) for s in (a, b))
    c = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    return {(a[i][0], b[j][0]): c[i, j] for i, j in zip(*np.nonzero(c >= threshold))}


@pytest.mark.parametrize("threshold,bits", [(0.82, 10), (0.92, 16), (0.6, 6)])
def test_recall_and_exactness(spark, threshold, bits):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    near = base + rng.uniform(0.1, 1.2, (300, 1)) * rng.standard_normal((300, 32))
    a, b = ([(i, v.tolist()) for i, v in enumerate(s)] for s in (base, near))
    sides = [vec.classes(spark.createDataFrame(s, "k int, v array<double>"), "k", "v") for s in (a, b)]
    got = {(r.left, r.right): r.similarity for r in vec.similar_classes(*sides, 32, threshold=threshold, bits=bits).collect()}
    want = brute(a, b, threshold)
    assert got.keys() <= want.keys() and len(got) >= 0.95 * len(want) and len(want) > 40
    assert all(math.isclose(s, want[p], abs_tol=1e-9) for p, s in got.items())


def test_equal_vectors_are_one_class_and_odd_ones_have_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.1]), (9, [1.0, 0.0, 0.0]), (2, [1.0, 0.0])]
    side = vec.classes(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v")
    assert sorted((r.member, r["class"]) for r in side.collect()) == [(1, 1), (2, 1), (2, 1), (8, 8), (9, 9)]
    found = vec.similar_classes(side, side, 2, threshold=0.9, bits=4, recall=0.9999).collect()
    assert sorted((r.left, r.right) for r in found) == [(1, 1), (1, 8), (8, 1), (8, 8)]
    empty = side.limit(0)
    assert vec.similar_classes(empty, side, 2, threshold=0.9).count() == 0


def test_registered_vectors_reach_the_recall(spark):
    rows = dict(sorted((r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()))
    mixed = {k: v + 0.5 * rows[k + 1] for k, v in rows.items() if k + 1 in rows}
    want = brute(list(rows.items()), list(mixed.items()), 0.82)
    from laborcast.plans import catalog
    got = {(r.vec_id, r.mixed_id) for r in catalog.QUERIES["k16_similar_vectors"](spark, SF).collect()}
    assert got <= want.keys() and len(got) >= 0.9 * len(want) and len(want) > 20


def test_semantic_step_of_the_gap(spark):
    need = spark.createDataFrame([("r", "sql_server", "SQL servers", True, 0, 1.0, 3, "High"), ("r", "cooking", "Cooking", True, 1, 0.5, 2, "Low"), ("r", "sql", "SQL", True, 2, 0.5, 2, "Low")],
                                 "target_role string, skill_id string, display string, in_taxonomy boolean, position int, importance double, required_level int, priority string")
    names = spark.createDataFrame([("mssql", "SQL server"), ("sql", "SQL"), ("chess", "Chess")], "id string, display string")
    side = lambda df, key: vec.classes(df.select(key, vec.gram_vector(F.col("display")).alias("v")), key, "v")
    asked, had = side(need, "skill_id"), side(names, "id")
    alike = vec.similar_classes(asked, had, 256, threshold=0.7, recall=0.9999)
    pairs = alike.select(F.col("left").alias("skill_id"), F.col("right").alias("have_id"), "similarity")
    profile = spark.createDataFrame([(1, "mssql", 3, 0.9, False, True), (1, "chess", 2, 0.9, False, True), (2, "sql", 2, 0.9, False, True)],
                                    "candidate_id int, skill_id string, level int, confidence double, needs_verification boolean, supported boolean")
    people = spark.createDataFrame([(1, "r"), (2, "r")], "candidate_id int, target_role string")
    none = spark.createDataFrame([], "required_id string, have_id string, rule int")
    rows = gap.gap_rows(people, need, profile, none, vec.similar_offers(people, profile, pairs))
    got = {(r.candidate_id, r.skill_id): (r.status, r.reason, r.via) for r in rows.collect()}
    assert got[1, "sql_server"][1:] == ("semantic", "mssql") and got[1, "sql_server"][0] in ("matched", "adjacent")
    assert got[1, "cooking"] == ("missing", None, None) and got[2, "sql"] == ("matched", "exact", "sql")
