import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from laborcast.llm import simhash
from laborcast.llm.components import components
from laborcast.llm.queries_simhash import op7_simhash
from laborcast.llm.simhash import fingerprint_links, first_masks, near_duplicates

ROOT = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in docs.items()}
    expected = brute_components(prints)
    got = {r.doc_id: r for r in op7_simhash(spark, ROOT).collect()}
    assert got.keys() == docs.keys()
    for k in docs:
        assert got[k].fingerprint == f"{prints[k]:016x}"
        assert got[k].component_id == expected[k]


@pytest.mark.parametrize("group", [1 << 16, 40])
def test_links_join_what_brute_force_joins(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    while len(values) < 700:
        base = rng.getrandbits(64) if rng.random() < .3 else rng.choice(sorted(values))
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        values.add(base)
    signed = {v: int(np.uint64(v).astype(np.int64)) for v in values}
    links = fingerprint_links(spark.createDataFrame([(v, 0) for v in signed.values()], "fingerprint long, tab int")).collect()
    for r in links:
        assert 0 < ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
    roots = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"), "a", "b").collect()}
    expected = brute_components({s: v for v, s in signed.items()})
    assert {s: roots.get(s, s) for s in signed.values()} == expected


def test_masks_cover_every_choice_of_bits():
    masks = first_masks(3)
    rng = random.Random(1)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not x & m for m in masks)


def test_edge_rows(spark):
    schema = "doc_id long, text string, fingerprint string, component int"
    rows = [(5, None, "x", 1), (4, "", None, None), (3, "a b c", "q", 1), (3, "A  b\tc", "q", 1), (9, "one two three four " * 50_000, "x", 2), (None, "a b c", "x", 2)]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component) for r in got) == [(-1, 3), (3, 3), (3, 3), (4, 4), (5, 4), (9, 9)]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def jaccard(a, b):
    sets = [{" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1


def test_deduplication_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rng = random.Random(2)
    for i, k in enumerate(rng.sample(sorted(k for k in docs if len(docs[k].split()) > 60), 40)):
        words = docs[k].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"edit{i}"
        docs[1000 + i] = " ".join(words)
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if jaccard(docs[a], docs[b]) >= .8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    expected = {k for k in docs if find(k) == k}
    out = simhash.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert len(expected) < len(docs) - 30


def test_deduplication_of_edge_rows(spark):
    schema = "doc_id long, text string, digest string, k int, __x int"
    rows = [(5, None, "x", 1, 1), (4, "", None, None, 1), (3, "a b c", "q", 1, 1), (3, "a b c", "q", 1, 1), (7, "A B  c", "q", 1, 1), (9, "one two three four " * 50_000, "x", 2, 1), (None, "a b c d", "x", 2, 1), (None, "only", "x", 2, 1)]
    frame = spark.createDataFrame(rows, schema)
    out = simhash.deduplicated(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text[:7]) for r in out.collect()) == [(0, "a b c d"), (0, "only"), (3, "a b c"), (4, ""), (9, "one two")]
    assert simhash.deduplicated(frame.limit(0)).count() == 0


def kept_by_brute_force(docs):
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if jaccard(docs[a], docs[b]) >= .8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in docs if find(k) == k}


def deduplicated_ids(spark, docs):
    return {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}


def test_shuffled_texts_between_near_copies(spark):
    rng, docs = random.Random(4), {}
    for group in range(8):
        words = [f"w{group}x{i}" for i in range(120)]
        for copy in range(9):  # one set of words: near copies and texts in another order, mixed by the order of their nodes
            own = words[:]
            if copy % 3:
                rng.shuffle(own)
            else:
                at = rng.randrange(100)
                own[at], own[at + 1] = own[at + 1], own[at]
            docs[10 * group + copy] = " ".join(own)
    expected = kept_by_brute_force(docs)
    assert len(expected) == 8 * 7
    assert deduplicated_ids(spark, docs) == expected


def test_passages_appended_truncated_and_replaced(spark):
    rng, docs, partners = random.Random(5), {}, 0
    vocabulary = [f"v{i}" for i in range(4000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for i in range(60):
        words, share = draw(rng.randint(80, 400)), rng.uniform(.04, .18)
        n = int(len(words) * share)
        if i % 3 == 0:
            other = words + draw(n)
        elif i % 3 == 1:
            other = words[:len(words) - n]
        else:
            at = rng.randrange(len(words) - n)
            other = words[:at] + draw(n // 2) + words[at + n // 2:]
        docs[2 * i], docs[2 * i + 1] = " ".join(words), " ".join(other)
        partners += jaccard(docs[2 * i], docs[2 * i + 1]) >= .8
    expected = kept_by_brute_force(docs)
    assert len(docs) - len(expected) == partners > 50
    got = deduplicated_ids(spark, docs)
    print("partners", partners, "found", len(docs) - len(got))
    assert got == expected


def test_unlike_pairs_of_a_large_group_are_no_rows():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, 100)) for _ in range(300)]
    sets += [np.unique(np.append(s[5:], rng.integers(-(1 << 62), 1 << 62, 5))) for s in sets[:20]]  # alike
    n = len(sets)
    columns = [pa.array(x, pa.int64()) for x in (np.zeros(n), range(n), map(len, sets), np.zeros(n), range(n))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(map(simhash.sketch, sets), pa.binary())], names=["h", "node", "size", "pos", "root", "sketch"])
    got = {(a, b) for part in simhash._group_pairs(True)([batch]) for a, b in zip(*(c.to_pylist() for c in part.columns))}
    assert {(300 + i, i) for i in range(20)} <= got and len(got) < 100  # of 51,040


def test_sketches_never_exclude_like_sets():
    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 60, 3000, 200_000):  # the last has no sketch
        common = rng.integers(-(1 << 62), 1 << 62, size)
        a, b = (np.unique(np.append(common, rng.integers(-(1 << 62), 1 << 62, size // 9))) for _ in range(2))
        x, y = (simhash._sketches(pa.array([simhash.sketch(s)], pa.binary())) for s in (a, b))
        assert simhash.similarity(a, b) >= simhash.SIMILAR and simhash._sketch_allows(x, y, np.array([len(a) + len(b)])).all()
    assert simhash.sketch(a) is None
