import numpy as np

from laborcast.llm import mixing
from laborcast.llm.mixing import copies, fit_rates, memberships, train
from laborcast.llm.queries_mixing import DOMAINS, TARGETS, labelled, op9_mixing

ROOT = "/root/testdata/sf0.01"


def test_query_matches_targets_and_brute_force(spark):
    rows = op9_mixing(spark, ROOT).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.n_tokens == len(docs[r.doc_id].encode().split()) for r in rows)
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in DOMAINS] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    a, goal = n / n.sum(), np.array(TARGETS)
    # The same problem with dense steps until nothing moves.
    mass = a @ p
    w = 1 / mass
    r = np.ones(len(n))
    step = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T * a @ p) * np.sqrt(w)).max() + mixing.KEEP)
    for _ in range(3000):
        r = np.maximum(0, r - step * (p @ (w * ((a * r) @ p - goal)) + mixing.KEEP * (r - 1)))
    assert np.abs((a * rate) @ p - (a * r) @ p).max() < 1e-3
    assert np.abs((a * rate) @ p - goal).max() < 5e-3
    labels = {r.doc_id: r.domain for r in labelled(spark, ROOT).collect()}
    toxic, good = ([x for x, row in zip(rate, rows) if labels.get(row.doc_id) == d] for d in ("toxic", "good"))
    print("toxic below half", np.mean(np.array(toxic) < .5), "good at least one", np.mean(np.array(good) >= 1), "good below half", np.mean(np.array(good) < .5))
    assert np.mean(np.array(toxic) < .5) > .85 and np.mean(np.array(good) >= .9) > .8 > np.mean(np.array(toxic) >= .9)


def test_held_out_posteriors(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    labels = labelled(spark, ROOT)
    model = train(docs, labels.where("doc_id % 3 > 0"), DOMAINS)
    got = memberships(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("posterior", "domain").collect()
    right = np.mean([DOMAINS[int(np.argmax(r.posterior))] == r.domain for r in got])
    print("held-out accuracy", right, [w.decode() for w in model.words])
    assert right > .9


def test_copies_follow_the_rates(spark):
    frame = spark.createDataFrame([(i, "x", 0, [1.0], float(i % 4) / 2 + .25) for i in range(4000)], "doc_id long, text string, n_tokens long, posterior array<double>, rate double")
    out = copies(frame, ["doc_id", "text"])
    assert out.columns == ["doc_id", "text"]
    assert abs(out.count() - 4000) < 120
    assert copies(frame, ["doc_id"], most=1).groupBy("doc_id").count().where("count > 1").count() == 0


def test_edge_rows(spark):
    schema = "doc_id long, text string, rate string, domain int"
    rows = [(1, None, "x", 1), (2, "", None, None), (2, "", None, None), (None, "word " * 200_000, "x", 3), (4, "bad bad bad", "y", 2), (5, "good one here", "y", 2)]
    docs = spark.createDataFrame(rows, schema)
    none = train(docs, spark.createDataFrame([], "doc_id long, domain string"), ["a", "b"])
    out = fit_rates(memberships(docs, none), [.5, .5])
    assert out.columns == ["doc_id", "text", "domain", "n_tokens", "posterior", "rate"]
    assert out.count() == 6 and {tuple(r.posterior) for r in out.collect()} == {(.5, .5)}
    assert all(abs(r.rate - 1) < 1e-6 for r in out.collect())
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (5, "b"), (None, "a"), (1, None), (2, "other")], "doc_id long, domain string")
    model = train(docs, labels, ["a", "b", "never"])
    rates = fit_rates(memberships(docs.where("doc_id in (1, 4, 5)"), model), [.5, .5, 0])
    assert all(r.rate >= 0 and np.isfinite(r.rate) for r in rates.collect())
    assert fit_rates(memberships(docs.limit(0), model), [1, 1, 1]).count() == 0
    assert {r.rate for r in fit_rates(memberships(docs.where("doc_id < 3"), model), [1, 1, 1]).collect()} == {1.0}


def test_rates_stay_near_one_where_domains_look_alike(spark):
    rng = np.random.default_rng(1)
    p = np.clip(.04 + .01 * rng.normal(size=2000), .001, .2)
    frame = spark.createDataFrame([(i, 10, [float(1 - x), float(x)]) for i, x in enumerate(p)] + [(5000 + i, 10, [0.0, 1.0]) for i in range(200)], "doc_id long, n_tokens long, posterior array<double>")
    rows = fit_rates(frame, [.99, .01], total=1.1, keep=.1).collect()
    alike, other = ([r.rate for r in rows if (r.doc_id >= 5000) == far] for far in (False, True))
    assert min(alike) >= 1 and max(alike) < 1.5 and max(other) < .4
