import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from laborcast.llm import quality_model
from laborcast.llm.queries_bpe import VOCABULARY
from laborcast.llm.queries_quality_model import learned_from

from .test_secrets import base, entropy
from .test_simhash import jaccard

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_keeps_what_the_forest_accepts(spark, docs):
    out = corpus_pipeline.quality(spark, docs, ROOT)
    assert out.columns == COLUMNS
    forest = quality_model.train(docs, learned_from(spark.read.parquet(f"{ROOT}/labels.parquet")))
    everything = rows(docs)
    scores = forest.score(np.array([quality_model.statistics(r.text) for r in everything.values()]))
    assert set(rows(out)) == {k for k, s in zip(everything, scores) if s >= .3}
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{ROOT}/labels.parquet'").fetchall())
    good = [k for k in everything if labels.get(k) == 1]
    assert len(set(good) & set(rows(out))) > .95 * len(good)


def test_near_duplicates_leave_one_of_each_group(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, ROOT)
    assert out.columns == COLUMNS
    kept, everything = rows(out), rows(docs)
    assert all(kept[k] == everything[k] for k in kept)
    for k in everything.keys() - kept.keys():
        assert any(jaccard(everything[k].text, everything[j].text) >= .8 for j in everything if j != k)
    left = sorted(kept)
    assert not any(jaccard(kept[a].text, kept[b].text) >= .8 for i, a in enumerate(left) for b in left[:i])


def test_secrets_are_masked(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = corpus_pipeline.secret_scan(spark, docs, root)
    assert out.columns == COLUMNS
    got, changed = rows(out), 0
    for k, r in rows(docs).items():
        spans = sorted((s, e) for s, _, e, _ in base(r.text) + entropy(r.text))
        text, at = "", 0
        for s, e in spans:
            if s >= at or not at:
                text += r.text[at:s] + "[SECRET]"
            at = max(at, e)
        text += r.text[at:]
        assert got[k].text == text and got[k].n_chars == (len(text) if spans else r.n_chars)
        changed += bool(spans)
    assert changed


def test_mixture_keeps_good_documents(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = corpus_pipeline.mixture(spark, docs, root)
    assert out.columns == COLUMNS
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(kept) == len(set(kept))
    labels = duckdb.connect().execute(f"SELECT doc_id, quality, toxic FROM '{root}/labels.parquet'").fetchall()
    good = [k for k, q, t in labels if q == 1 and t == 0]
    toxic = [k for k, q, t in labels if t == 1]
    assert len(set(good) & set(kept)) > .9 * len(good) and len(set(toxic) & set(kept)) < .4 * len(toxic)


def test_encoding(spark, docs):
    got = rows(corpus_pipeline.encoding(spark, docs, ROOT))
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for k, r in rows(docs).items():
        assert got[k].ids == tokenizer.encode(r.text, add_special_tokens=False).ids == got[k].ids and got[k].n_tokens == len(got[k].ids)
        assert got[k].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_applies_the_stages_in_order(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secret_scan", "mixture", "encoding"]
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, ROOT)
    expected, got = rows(step), rows(corpus_pipeline.run(spark, ROOT))
    assert got == expected and 0 < len(got) < docs.count()


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, node long"
    plain = "ordinary words that make a plain text of some length here and on"
    data = [(1, None, None, None, None, "x", 1.0, 1), (2, "", "en", None, 0, None, None, None), (3, plain, None, "s", 5, "x", 1.0, 1), (3, plain, None, "s", 5, "x", 1.0, 1), (None, plain + " more", "en", "s", None, "x", 1.0, 1),
            (7, "words and more words " * 60_000, "en", "s", 1, "x", 1.0, 1), (8, "secret = abcdef123 " + plain, "en", "s", 1, "x", 1.0, 1)]
    frame = spark.createDataFrame(data, schema)
    for name, stage in corpus_pipeline.STAGES:
        for some in (frame, frame.limit(0)):
            out = stage(spark, some, ROOT)
            if name != "encoding":
                assert out.columns == frame.columns, name
            found = out.collect()
            assert len(found) <= some.count()
            if name == "secret_scan" and found:
                assert any(r.text == "[SECRET] " + plain and r.n_chars == len(r.text) for r in found) and len(found) == 7
