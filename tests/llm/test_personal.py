import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from laborcast.llm.personal import BESIDE, KINDS, base_spans, examples, found_spans, lattices, luhn, masked, scan, spelled, train
from laborcast.llm.queries_personal import op12_personal_data
from laborcast.llm.segments import Lattice, Model, _Packed, fit

ROOT = "/root/testdata/sf0.01"


def plain(text):
    """The base spans by the plain patterns."""
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def passes(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and passes(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def cases(n):
    rng = random.Random(4)
    bits = ["a.b", "@", "@@", "x@y.z", "x@y.z@q.r", ".", "..", "-", " ", "  ", "+", "+1 (743) 555-3824", "1.2.3.4", "256.1.1.1", "0001.02.3.4", "4111111111111111", "4111 1111 1111 1111", "é@é.é", "\U0001f600",
            "12", "(", ")", "\n", "a%b+c_d@host-1.org", "+49.30.123456", "[at]", " at ", " dot ", "_", "7"]
    for _ in range(n):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet(f"{ROOT}/documents.parquet"))


def test_base_spans_against_plain_patterns(corpus):
    for text in [*cases(4000), *corpus.values()]:
        assert base_spans(text) == plain(text), text


def small_lattices(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        spans = sorted({tuple(sorted(rng.sample(range(7), 2))) for _ in range(rng.randint(1, 6))}, key=lambda s: (s[1], s[0]))
        yield Lattice([(a, b, [f"f{rng.randrange(5)}" for _ in range(rng.randint(0, 3))], tuple(sorted(rng.sample(range(3), rng.randint(1, 3))))) for a, b in spans])


def labellings(lattice):
    """Every set of segments that don't overlap, with types."""
    rows = range(len(lattice.candidates))
    for k in range(len(lattice.candidates) + 1):
        for chosen in itertools.combinations(rows, k):
            spans = sorted(lattice.candidates[r][:2] for r in chosen)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                yield from (list(zip(chosen, kinds)) for kinds in itertools.product(*[lattice.candidates[r][3] for r in chosen]))


def test_decoding_and_likelihood_against_all_labellings():
    rng = np.random.default_rng(2)
    weights = {f"f{i}": rng.normal(size=3) for i in range(5)}
    model = Model(weights, 3)
    for lattice in small_lattices(150, 1):
        scores = model.scores(lattice)
        totals = [sum(scores[r, k] for r, k in labelling) for labelling in labellings(lattice)]
        got = model.decode(lattice)
        place = {c[:2]: i for i, c in enumerate(lattice.candidates)}
        assert np.isclose(sum(scores[place[a, b], k] for a, b, k in got), max(totals)) and all(x[1] <= y[0] for x, y in itertools.pairwise(got))
        lattice.gold = max(labellings(lattice), key=len)
        packed = _Packed([lattice], 3)
        array = np.array([weights[n] for n in packed.names]).reshape(-1, 3)
        loss, _ = packed.loss(array)
        assert np.isclose(loss, np.logaddexp.reduce(totals) - sum(scores[r, k] for r, k in lattice.gold))


def test_gradient_by_differences():
    found = list(small_lattices(12, 3))
    for lattice in found:
        lattice.gold = max(labellings(lattice), key=len)
    packed = _Packed(found, 3)
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(len(packed.names), 3))
    _, gradient = packed.loss(weights)
    for i, k in itertools.product(range(len(weights)), range(3)):
        step = np.zeros_like(weights)
        step[i, k] = 1e-5
        assert np.isclose((packed.loss(weights + step)[0] - packed.loss(weights - step)[0]) / 2e-5, gradient[i, k], atol=1e-4)


def test_held_out_spellings(corpus):
    spans = sorted({(t[max(0, a - BESIDE):a], t[a:b], k, t[b:b + BESIDE]) for t in corpus.values() for a, k, b in base_spans(t)})
    model = fit(examples(spans[::2]), len(KINDS))
    right = wrong = missed = 0
    for lattice in examples(spans[1::2], seed=77):
        gold = {(*lattice.candidates[i][:2], k) for i, k in lattice.gold}
        got = set(model.decode(lattice))
        right, wrong, missed = right + len(gold & got), wrong + len(got - gold), missed + len(gold - got)
    assert right > 50 and wrong <= 0.03 * right and missed <= 0.05 * right


def test_planted_spellings_are_caught_and_clean_texts_left_alone(model, corpus):
    caught = {
        "phone": ["call 743-555-3824 now", "call (743) 555-3824 now", "tel 743.555.3824, or later", "It is 1-743-555-3824."],
        "email": ["ann [at] host [dot] org", "mail bob.ray(at)example.com please", "write jo.lee at example dot com today", "see jane@mail(dot)example(dot)com"],
        "card": ["4465758382889437 4465758382889437", "by 4465.7583.8288.9437 it is", "+1 (743) 555-3824 4465758382889437"],
        "ip": ["host 10[.]20[.]30[.]4 up"],
    }
    for kind, texts in caught.items():
        for text in texts:
            assert kind in {KINDS[k] for _, k, _ in found_spans(text, model)[1]}, text
    clean = ["on 2021-03-04 at 12:30:15", "ISBN 978-3-16-148410-0", "total 12,345,678.90 of 3", "order 1234567890123456", "look at the dot com years", "meet at noon", "pages 123-145, 2001-2004", "1.2.3 and 4.5.6",
             "hash 0123456789abcdef0123456789abcdef", "a @ b", "@home now", "3.14159265358979", "20210304123015", "x" * 5000]
    for text in clean:
        assert found_spans(text, model) == ([], []), text
    without = [t for t in corpus.values() if not re.search("[0-9@]", t)]
    assert len(without) > 500 and all(found_spans(t, model) == ([], []) for t in without)


def test_added_spans_never_overlap_base_spans(model):
    for text in cases(1500):
        base, both = found_spans(text, model)
        added = [s for s in both if s not in base]
        assert set(base) <= set(both) and base == base_spans(text)
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in added for b in base) and all(a[2] <= b[0] for a, b in itertools.pairwise(added))
        for lattice in lattices(text, base):
            assert all(c[0] < c[1] for c in lattice.candidates)


def test_query_against_plain_patterns(spark, corpus):
    rows = op12_personal_data(spark, ROOT).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        base = plain(corpus[r.doc_id])
        spell = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(spell).encode()).hexdigest() and set(spell) <= set(r.spans.split(",")) | ({""} if not spell else set())


def test_masks_and_edge_rows(spark, model):
    schema = "doc_id long, text string, spans string, __x int"
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, "é +1 (743) 555-3824 end", None, 1), (3, "é +1 (743) 555-3824 end", None, 1), (None, "ip 10.0.0.1, é a@b.co " * 3000, "s", None),
            (6, "1" * 300_000 + " " + "2 " * 50_000, "s", 1), (7, "a@" * 50_000 + "+" * 1000, "s", 2)]
    scanned = scan(spark.createDataFrame(rows, schema), model)
    assert scanned.columns == ["doc_id", "text", "__x", "base_spans", "spans"]
    clean = {(r.doc_id, r.text) for r in masked(scanned).collect()}
    assert clean == {(1, None), (2, ""), (3, "é [PHONE] end"), (None, "ip [IP], é [EMAIL] " * 3000), (6, rows[5][1]), (7, rows[6][1])}
    assert [r.s for r in scanned.where("doc_id = 3").select(spelled("spans").alias("s")).collect()] == ["phone:2:19"] * 2
    empty = spark.createDataFrame([], schema)
    assert scan(empty, train(empty)).count() == 0 and luhn("4111111111111111") and not luhn("4111111111111112")
