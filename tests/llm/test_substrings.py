import random

import duckdb
import pytest

from laborcast.llm import substrings
from laborcast.llm.queries_substrings import op8_substrings
from laborcast.llm.registry import ORACLES
from laborcast.llm.substrings import WIDTH, remove_repeats

ROOT = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    cols = "doc_id, n_words, n_removed, kept_sha256"
    expected = sorted(con.execute(f"SELECT {cols} FROM ({ORACLES['op8_substrings']})").fetchall())
    got = sorted(tuple(r) for r in op8_substrings(spark, ROOT).select(*cols.split(", ")).collect())
    assert got == expected and sum(r[2] for r in got) > 0


def brute(rows):
    first = {}
    split = [(d, (t or "").split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - WIDTH + 1):
            w = tuple(words[i:i + WIDTH])
            first[w] = min(first.get(w, 1 << 63), (1 << 62) if d is None else d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - WIDTH + 1):
            if first[tuple(words[i:i + WIDTH])] < ((1 << 62) if d is None else d):
                gone |= set(range(i, i + WIDTH))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("remembered", [200_000, 3])
def test_against_brute_force(spark, monkeypatch, remembered):
    monkeypatch.setattr(substrings, "REMEMBERED", remembered)
    rng = random.Random(remembered)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < .4 else " ".join(rng.choice("abcdefghijklmnop") + rng.choice(["", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(parts)))
    rows += [(3, "x " * 40), (5, "x " * 60), (9, passages[0]), (9, passages[0]), (11, None), (12, ""), (None, passages[1]), (2, " ".join(f"w{i}" for i in range(60_000))), (8, " ".join(f"w{i}" for i in range(50, 60_000)))]
    # Parts of few rows, so that equal strings also meet in the buckets and not only inside a part.
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame).collect()), key=str)
    assert got == brute(rows)


def test_edge_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "k", 5, None)], "doc_id long, text string, kept string, rid long, doc string")
    out = remove_repeats(frame)
    assert out.columns == ["doc_id", "text", "rid", "doc", "kept", "n_words", "n_removed"]
    assert tuple(out.first()) == (1, "a b", 5, None, "a b", 2, 0)
    assert remove_repeats(frame.limit(0)).count() == 0


def test_one_long_run_after_ordinary_words():
    rng = random.Random(6)
    words = [b"w%d" % rng.randrange(900) for _ in range(2000)] + [b"x"] * 1_100_000
    least = substrings.minimisers(words)
    start, end = substrings.segments(least)
    assert (start[1:] == end[:-1]).all() and start[0] == 0 and end[-1] == len(least)
    assert (end - start).max() <= substrings.LONGEST
    assert all((least[a:b] == least[a]).all() for a, b in zip(start, end))


def test_long_shared_run_is_removed_whole(spark):
    run = " x" * 1_100_000
    first, second = (" ".join(f"{name}{i}" for i in range(2001)) for name in "ab")
    frame = spark.createDataFrame([(1, first + run), (2, second + run)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame).collect()}
    assert got[1] == (1_102_001, 0, first + run)
    assert got[2] == (1_102_001, 1_100_000, second)
