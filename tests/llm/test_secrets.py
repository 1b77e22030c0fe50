import hashlib
import math
import random
import re
from collections import Counter

from laborcast.llm.queries_secrets import op2_secrets
from laborcast.llm.secrets import ALLOWED, CLASSES, JOINTS, PLAIN, WINDOW, redact, scan, spelled

ROOT = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        c = m[0]
        if len(c) < WINDOW or any(re.search(p, c) for p in ALLOWED) or re.search(JOINTS, c) and all(re.search(PLAIN, x) for x in re.split(JOINTS, c)):
            continue
        bits = next(least for _, p, least in CLASSES if not p or re.search(p, c))
        hot = []
        for i in range(len(c) - WINDOW + 1):
            counts = Counter(c[i:i + WINDOW]).values()
            if math.log2(WINDOW) - sum(round(n * math.log2(n) * 2**20) for n in counts) / 2**20 / WINDOW >= bits - 1e-9:
                hot.append(i)
        if hot:
            s, e = m.start() + hot[0], m.start() + hot[-1] + WINDOW
            if not any(b[0] <= s and e <= b[2] for b in base(text)):
                out.append((s, 3, e, "entropy"))
    return out


def spell(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def cases(n=400):
    rng = random.Random(8)
    sets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHabcdefgh0123456789+/", "aaaab1", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    words = ["password", "PASSWD:", "Token = ", "api_key=", "apikey", '"secret": "', "AKIA", "é\U0001f600", "the", "\n", "example", "'", ":", "=", "secret=secret=abcdef"]
    for _ in range(n):
        parts = [rng.choice(words) if rng.random() < .6 else "".join(rng.choice(rng.choice(sets)) if rng.random() < .02 else rng.choice(s) for s in [rng.choice(sets)] for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 9))]
        yield rng.choice(["", " "]).join(parts)


def test_spans_against_brute_force(spark):
    texts = list(cases())
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).select("doc_id", spelled("base_spans").alias("b"), spelled("spans").alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.b == spell(base(texts[r.doc_id])), texts[r.doc_id]
        assert r.s == spell(base(texts[r.doc_id]) + entropy(texts[r.doc_id])), texts[r.doc_id]
    assert sum("entropy" in r.s for r in rows) > 20


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = op2_secrets(spark, ROOT).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        found = base(docs[r.doc_id])
        n = Counter(s[3] for s in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(spell(found).encode()).hexdigest()
        assert r.spans == spell(found + entropy(docs[r.doc_id]))


def test_allow_list(spark):
    texts = ["550e8400-e29b-41d4-a716-446655440000", "id wJalrXUtnFEMI7K7MDENG9bPxRfiCYEXAMPLEKEY", "usr/local/share/python3/site", "wJalrXUtnFEMI7K7MDENG9bPxRfiCYzzYhTr2k"]
    got = {r.text: r.spans for r in scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [bool(got[t]) for t in texts] == [False, False, False, True]


def test_redaction_and_edge_rows(spark):
    schema = "doc_id long, text string, spans string, __x int"
    long_text = "token = abcdef12 plain é " * 3000
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, "é token = abcdef1 end", None, 1), (3, "é token = abcdef1 end", None, 1), (None, long_text, "s", None), (6, "ab1/" * 50_000 + " " + "q7Zx" * 9000, "s", 1), (5, "secret=" + "0a" * 20 + "! x", "s", 2)]
    scanned = scan(spark.createDataFrame(rows, schema))
    assert scanned.columns == ["doc_id", "text", "__x", "base_spans", "spans"]
    clean = {(r.doc_id, r.text) for r in redact(scanned).collect()}
    assert clean == {(1, None), (2, ""), (3, "é [SECRET] end"), (None, "[SECRET] plain é " * 3000), (6, "ab1/" * 50_000 + " " + "q7Zx" * 9000), (5, "[SECRET]! x")}
    assert scan(spark.createDataFrame([], schema)).count() == 0
