import zlib

import numpy as np

from laborcast.llm.quality_model import FEATURES, fit, score, statistics, train
from laborcast.llm.queries_quality_model import op3_quality_model

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = op3_quality_model(spark, ROOT).collect()
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in rows)
    good, bad = ([r.score for r in held if labels[r.doc_id] == q] for q in (1, 0))
    auc = np.mean([(g > b) + .5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([r.predicted == labels[r.doc_id] for r in held])
    print("auc", auc, "accuracy", accuracy)
    assert auc > .9 and accuracy > .9


def test_forest_agrees_with_walking_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(FEATURES)))
    y = ((x[:, 3] > 0) ^ (x[:, 5] > .5)).astype(float)
    forest = fit(x, y, trees=20)
    assert ((forest.score(x) > .5) == y).mean() > .9
    for row, got in zip(x[:50], forest.score(x[:50])):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12


def test_edge_rows(spark):
    schema = "doc_id long, text string, score string, extra int"
    rows = [(1, None, "x", 1), (2, "", None, None), (2, "", None, None), (None, "word " * 300_000, "x", 3), (3, "\n \t", "y", 1), (4, "ordinary words here", "y", 2)]
    docs = spark.createDataFrame(rows, schema)
    none = train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = score(docs, none)
    assert out.columns == ["doc_id", "text", "extra", "score"]
    assert {r.score for r in out.collect()} == {.5} and out.count() == 6
    labels = spark.createDataFrame([(4, 1), (4, 1), (1, 0), (None, 1), (2, None), (77, 1)], "doc_id long, quality int")
    assert train(docs, labels).base == float(np.log((3 / 5) / (2 / 5)))
    assert score(spark.createDataFrame([], schema), none).count() == 0
    assert statistics("") == statistics(" \n") == [0.0] * len(FEATURES)
