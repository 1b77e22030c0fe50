import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from laborcast.llm import lexical
from laborcast.llm.lexical import SCALE, Postings, build_index, posting_lists, search


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(docs, items, k):
    """(item, rank, doc, score) of every item row, whole scores over all documents."""
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 75 + 25 * c.total() * n_docs // max(1, n_terms)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (SCALE * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "x" * 300, "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 20, 80]))) + rng.choice(["", ".", "\n", "_the"])) for i in range(n)], rng


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("block,span,shard", [(128, 2048, 16 << 20), (4, 16, 3000), (1, 1, 1)])
def test_search_against_brute_force(spark, monkeypatch, block, span, shard):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SPAN", span)
    docs, rng = corpus(700 if shard > 1 else 120, 5)
    docs += [docs[3], docs[3], (None, docs[3][1]), (None, None), (9001, None), (9002, ""), (9003, "w1 w2 the " * 30_000)]
    items = [(i, " ".join(rng.choice(docs)[1].split()[:30]) if rng.random() < .6 else " ".join(f"w{rng.randrange(500)}" for _ in range(12))) for i in range(40)]
    items += [items[0], (None, "w3 W3 w3 été"), (50, None), (51, "unknown ..."), (52, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = build_index(frame, shard=shard)
    got = [tuple(r) for r in search(index, spark.createDataFrame(items, "item_id long, text string"), k=7).collect()]
    assert order(got) == order(brute(docs, items, 7))


def test_groups_of_queries_and_shuffled_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_ROWS", 3)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    docs, rng = corpus(200, 6)
    items = [(f"i{i}", rng.choice(docs)[1]) for i in range(8)]
    named = spark.createDataFrame([(f"d{k:04}", t, 1) for k, t in docs], "score string, body string, rank int")
    index = build_index(named, text="body", key="score")
    out = search(index, spark.createDataFrame(items, "q string, body string"), k=5, text="body", key="q", doc="d")
    assert out.columns == ["q", "rank", "d", "score"]
    assert order(map(tuple, out.collect())) == order(brute([(f"d{k:04}", t) for k, t in docs], items, 5))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = search(build_index(docs), items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    full = build_index(spark.createDataFrame([(1, "a"), (2, "c")], docs.schema))
    assert [tuple(r)[:3] for r in search(full, items).collect()] == [(1, 1, 1)] and search(full, items.limit(0)).collect() == []


def test_blocks_hold_the_lists_and_stay_closed_when_bounds_reject():
    texts = ["rare common " * (5 if i == 0 else 1) if i in (0, 4000) else "common " * (1 + i % 400) for i in range(4001)]
    found = posting_lists(pa.array(texts), len(texts), sum(len(t.split()) for t in texts))
    m = found[5]
    lists = {t: (b, Postings(h, x, m)) for t, b, h, x in zip(*(found[i].to_pylist() if i != 2 else found[i].tolist() for i in (0, 2, 3, 4)))}
    bound, common = lists[b"common"]
    blocks = [common.block(i) for i in range(len(common.last))]
    assert np.concatenate([b[0] for b in blocks]).tolist() == list(range(4001)) and max(b[1].max() for b in blocks) == bound
    for (docs, impacts), last, most in zip(blocks, common.last, common.bounds):
        assert docs[-1] == last and impacts.max() == most
        assert impacts.tolist() == [SCALE * tf // (1000 * tf + 12 * int(m[d])) for d in docs.tolist() for tf in [texts[d].split().count("common")]]
    common.read.clear()
    rare = (1000, lists[b"rare"][0], lists[b"rare"][1])
    top, scores = lexical.best([rare, (1, bound, common)], len(texts), np.arange(len(texts)), 1)
    assert top.tolist() == [0] and max(common.read) < len(common.last) / 2 + 1  # after the first span, "common" proposes nothing
