import random
import re

from pyspark.sql import functions as F

from laborcast.functions import posting_text
from laborcast.operators import textmine
from laborcast.plans.lenses import WORD_ALIASES

RUN = r"[\w+#&.]"


def plain_hits(text, aliases):
    """Every alias by its own regular expression, longest match first, then by place and by order of the skills."""
    spans = []
    for order, (skill, alias) in enumerate(aliases):
        body = r"[\s\-_]{0,2}".join(re.escape(p) for p in re.split(r"[\s\-_]+", alias) if p)
        spans += [(-len(m[0]), m.start(), order, m.end(), skill, m[0]) for m in re.finditer(rf"(?<![\w+#&.])(?:{body})(?![\w+#&])", text, re.I)]
    kept = []
    for s in sorted(spans):
        if all(s[3] <= k[1] or k[3] <= s[1] for k in kept):
            kept.append(s)
    return sorted((k[4], k[5]) for k in kept)


def taxonomy(spark, aliases, rules=None):
    ids = list(dict.fromkeys(a for a, _ in aliases))
    skills = spark.createDataFrame([(s, s, None, [], 1, False, i) for i, s in enumerate(ids)],
                                   "id string, display string, maps_to string, prerequisites array<string>, difficulty_tier int, is_category boolean, load_id int")
    return skills, spark.createDataFrame([(s, a, (rules or {}).get(a)) for s, a in aliases], "id string, alias string, rule string")


def test_whole_documents_against_plain_regular_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NOT NULL AND text NOT LIKE '%@%' AND text NOT LIKE '%://%'")
    skills, aliases = taxonomy(spark, WORD_ALIASES)
    order = sorted(WORD_ALIASES, key=lambda a: [s for s, _ in WORD_ALIASES].index(a[0]))
    got: dict[int, list] = {}
    for r in textmine.skill_hits(docs, "doc_id", "text", skills, aliases).collect():
        got.setdefault(r.doc_id, []).append((r.skill_id, r.surface))
    found = 0
    for r in docs.collect():
        assert sorted(got.get(r.doc_id, [])) == plain_hits(r.text, order), r.doc_id
        found += len(got.get(r.doc_id, []))
    assert found > 100


def test_aliases_with_marks_inside_and_shared_beginnings(spark):
    pairs = [("cicd", "ci/cd"), ("ci", "ci"), ("tcp", "TCP/IP stack"), ("node", "node.js"), ("sk", "scikit_learn"), ("q", "it's fine\\ok"), ("a", "big data"), ("b", "big data tools and more things"), ("b", "big  data")]
    skills, aliases = taxonomy(spark, pairs)
    texts = ["CI/CD and ci, CI / CD", "tcp/ip Stack or tcp/ip", "Node.js. node.js.x nodejs", "scikit learn Scikit-Learn scikitlearn scikit_learn", "IT's fine\\ok!", "big data tools and more", "Big-Data tools and more things; big\ndata",
             "", None, "big " * 20_000 + "data"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict[int, list] = {}
    for h in textmine.skill_hits(docs, "id", "text", skills, aliases).collect():
        got.setdefault(h.id, []).append((h.skill_id, h.surface))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_hits(text or "", pairs), text


def test_texts_are_read_once_without_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    skills, aliases = taxonomy(spark, [("c", "c"), ("py", "python")], {"c": "list"})
    plan = textmine.alias_mentions(docs, "doc_id", "text", skills, aliases, F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_contacts_are_left_out_as_by_the_plain_pattern(spark):
    plain = r"(?i)\S+@\S+|(?:https?://|www\.)\S+|\b(?:linkedin|github|gitlab|kaggle|leetcode|medium)[.\s]com\S*"
    rng = random.Random(3)
    parts = ["@", "a", "b@c", "@x", "y@", "http://", "HTTPS://q", "www.", "WWW.a", "linkedin.com", "LinkedIn com/x", "xgithub.com", "github\ncom",
             "medium.comz", " ", "\n", "\t", " ", "é", ".", "\x1c", "\x0b", "(", "kaggle", "com", "\U0001F600", "ſ", "K"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(5000)] + [(None,)]
    texts = spark.createDataFrame(rows, "text string")
    expected = F.regexp_replace(F.coalesce("text", F.lit("")), plain, " ")
    assert texts.where(expected != F.coalesce("text", F.lit(""))).count() > 1000
    assert texts.where(~expected.eqNullSafe(posting_text.strip_contacts(F.col("text")))).count() == 0


def test_words_and_gaps(spark):
    rows = [(1, "  C++ and\tR&D, node.js.\n\n — été_x\n!\n日本 ٣\u0301a"), (2, ""), (3, " ,\n"), (4, None), (5, "a\nb")]
    got = {r.id: [(t.gap, t.w, t.u, t.j) for t in r._t] for r in textmine.words_in_units(spark.createDataFrame(rows, "id int, text string"), "text", [F.col("id")]).collect()}
    assert got[1] == [("  ", "C++", 0, 0), (" ", "and", 0, 1), ("\t", "R&D", 0, 2), (", ", "node.js.", 0, 3), ("\n\n — ", "été_x", 1, 0),
                      ("\n!\n", "日本", 2, 0), (" ", "٣\u0301a", 2, 1)]
    assert got[2] == got[3] == got[4] == [] and got[5] == [("", "a", 0, 0), ("\n", "b", 1, 0)]


def test_a_text_without_contacts_meets_no_contact_pattern(spark):
    """the pattern stands under a test of the text, and every word is tested against a set and not by a walk of the tree."""
    texts = spark.createDataFrame([(1, "python")], "id int, text string")
    plan = texts.select(posting_text.strip_contacts(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index("regexp_replace")
    skills = spark.createDataFrame([("python", 0), ("sql", 1)], "id string, load_id int")
    aliases = spark.createDataFrame([("python", f"python{i}", None) for i in range(12)], "id string, alias string, rule string")
    plan = textmine.alias_mentions(texts, "id", "text", skills, aliases, F.lit(False))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan or " IN (" in plan
