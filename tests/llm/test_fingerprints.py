import hashlib
import random

import numpy as np

from laborcast.llm import fingerprints
from laborcast.llm.fingerprints import K, LENGTH, SLOTS, compare_neighbours, likeness, signature, spelled, with_fingerprints
from laborcast.llm.queries_fingerprints import op6_fingerprints

ROOT = "/root/testdata/sf0.001"


def brute(text):
    """The same choice with dictionaries and sorted lists."""
    if not text:
        return spelled(np.zeros(SLOTS, np.uint32))
    k = min(K, len(text))
    seen, mers = {}, []
    one = np.uint64
    with np.errstate(over="ignore"):
        for i in range(len(text) - k + 1):
            mer = text[i:i + k]
            h = np.array([k], np.uint64)
            for c in mer:
                h = h * one(0x9E3779B97F4A7C15) + one(ord(c))
            h = fingerprints._mix(h)
            n = seen[mer] = seen.get(mer, -1) + 1
            mers.append((int(h[0] if n == 0 else fingerprints._mix(h + one(n) * one(0xD6E8FEB86659FD93))[0]), i))
        out = []
        for s in range(SLOTS):
            own = sorted(m for m in mers if m[0] >> 58 == s)[:LENGTH]
            if not own:
                out.append(0)
                continue
            total = np.array([LENGTH], np.uint64)
            values = [v for v, _ in sorted(own, key=lambda m: m[1])] + [0] * (LENGTH - len(own))
            for v in values:
                total = fingerprints._mix(total * one(0x9E3779B97F4A7C15) + one(v))
            out.append(max(1, int(total[0]) >> 32))
    return spelled(np.array(out, np.uint32))


def test_query_against_brute_force(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op6_fingerprints(spark, ROOT).collect()}
    assert len(got) == len(docs)
    decode = lambda s: np.frombuffer(bytes.fromhex(s), ">u4")
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = got[k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == likeness(decode(row.fingerprint), decode(row.edited_fingerprint))
        assert row.near_next == likeness(decode(row.fingerprint), decode(got[docs[(i + 1) % len(docs)][0]].fingerprint))
        if i < 60:
            assert row.fingerprint == brute(text) and row.edited_fingerprint == brute(edited)
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + .1


def test_order_and_edits_lower_the_likeness():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    few = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    many = " ".join(w if i % 5 else "changed" for i, w in enumerate(words))
    moved = " ".join(words[200:] + words[:200])
    s = signature(text)
    assert likeness(s, signature(text)) == 1
    assert likeness(s, signature(few)) > likeness(s, signature(many))
    assert likeness(s, signature(moved)) < .8  # the same k-mers, another order
    assert likeness(signature(""), signature("")) == 1 and likeness(signature(""), s) == 0


def test_edge_rows(spark):
    schema = "doc_id long, text string, fingerprint int, part int"
    long_text = "long text é " * 200_000
    rows = [(3, "abcdef", 1, 1), (3, "abcdef", 1, 1), (None, "zz", 1, 1), (1, None, None, None), (9, "\U0001f600bcd", 2, 2), (2, long_text, 3, 3)]
    frame = spark.createDataFrame(rows, schema)
    got = compare_neighbours(frame).collect()
    want = [(9, "\U0001f600bab"), (3, "abcabc"), (3, "abc" + long_text[:3]), (2, long_text[:len(long_text) // 2]), (1, ""), (None, "z\U0001f600")]
    assert sorted(((r.doc_id, r.edited) for r in got), key=str) == sorted(want, key=str)
    one = compare_neighbours(frame.where("doc_id = 9")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("\U0001f600b\U0001f600b", 1.0)]
    assert compare_neighbours(frame.limit(0)).count() == 0
    assert with_fingerprints(frame).columns == ["doc_id", "text", "part", "fingerprint"]
