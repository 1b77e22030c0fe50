import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from laborcast.llm.importance import draw, learn_gains, resample, runs, weigh
from laborcast.llm.position_crc import BLOCK, crc32_spans


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    """(key, n_words, n_features, weight, score) of each row, and the drawn (score, key) in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs_of(t, longest))
    t = Counter(bucket(f) for x in target for f in runs_of(x, longest))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for key, text in docs:
        f = runs_of(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // max(1, len(f))
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] if r[0] is not None else -1) for r in rows if r[1] >= least)
    return rows, able[:percent * len(able) // 100]


def test_crc_of_spans():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(9000))
    lengths = [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 2 * BLOCK + 1, 4000]
    spans = [(s, min(rng.choice(lengths), 9000 - s)) for s in (rng.randrange(9000) for _ in range(2000))]
    got = crc32_spans(np.frombuffer(data, dtype=np.uint8), *map(np.array, zip(*spans)))
    assert [zlib.crc32(data[a:a + n]) for a, n in spans] == got.tolist()
    assert crc32_spans(np.empty(0, dtype=np.uint8), np.array([]), np.array([])).tolist() == []


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_of_words(longest):
    texts = [None, "", "ABC abc", "x", "ÀB é1\x00\x7f{z}", "", "end", "start of_next", "ﬀ\U0001f600 " * 3, "w" * 500 + " " + "y" * 64 + "É" * 40]
    crcs, n, k = runs(pa.array(texts), longest)
    assert n.tolist() == [len(runs_of(t, longest)) for t in texts] and k.tolist() == [len(words_of(t)) for t in texts]
    ends = np.cumsum(n)
    for t, end, m in zip(texts, ends, n):
        assert sorted(crcs[end - m:end].tolist()) == sorted(zlib.crc32(f.encode()) for f in runs_of(t, longest))
    whole = pa.array(["skipped", *texts])
    assert runs(whole.slice(1), longest)[0].tolist() == crcs.tolist()  # a slice begins at an offset


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_against_brute_force(spark, longest):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma9", "délta", "x" * 90, "the", "of"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    docs += [(7, docs[7][1]), (None, None), (None, "word " * 30), (None, "word " * 30), (9001, ""), (9002, "Beta! " * 20_000)]
    target = ["beta gamma9 beta", None, "", "délta the"]
    frame = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(docs)], "doc_id long, text string, i int").repartition(5)
    gains = learn_gains(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    found = draw(weigh(frame, gains).drop("text")).collect()
    rows, drawn = brute(docs, target, longest)
    assert len(found) == len(docs)
    for r in found:
        assert (r.doc_id, r.n_words, r.n_features, r.weight, r.score) == rows[r.i]
    ranked = sorted((r["rank"], -r.score, -1 if r.doc_id is None else r.doc_id) for r in found if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn


def test_equal_rows_clashing_columns_and_empty_tables(spark):
    same = [(None, "one two three " * 10, i, "kept") for i in range(300)]  # a single key, text and score
    frame = spark.createDataFrame(same, "doc_id long, text string, score int, row string").repartition(7)
    empty = spark.createDataFrame([], frame.schema)
    out = resample(frame, empty, percent=20)
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_features", "weight", "score", "rank"]
    rows = out.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 61)) and {r["row"] for r in rows} == {"kept"}
    assert resample(empty, frame).collect() == [] and resample(empty, empty).collect() == []
    assert resample(frame, frame, percent=0).collect() == [] and len(resample(frame, frame, percent=100).collect()) == 300
