from laborcast.operators import enrichment as en, textmine


def taxonomy(spark, pairs):
    ids = ["js", "py", "ml", "react"]
    skills = spark.createDataFrame([(s, s, None, [], 1, False, i) for i, s in enumerate(ids)],
                                   "id string, display string, maps_to string, prerequisites array<string>, difficulty_tier int, is_category boolean, load_id int")
    return skills, spark.createDataFrame([(s, a, r) for s, a, r in pairs], "id string, alias string, rule string")


PAIRS = [("js", "javascript", None), ("py", "python", None), ("ml", "machine learning", None)]
TEXTS = {1: "Python and JavaScript", 2: "machine-learning", 3: "nothing", 4: None, 5: "", 6: "react native Python", 7: "machine learning systems"}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id int, text string")


def as_dict(df):
    return {r["id"]: (r.skills, r.reason) for r in df.collect()}


def test_only_what_changed_is_extracted_again(spark, monkeypatch):
    skills, aliases = taxonomy(spark, PAIRS)
    stored = en.extracted(frame(spark, TEXTS), "id", "text", skills, aliases)
    again = as_dict(en.refreshed(frame(spark, TEXTS), stored, "id", "text", skills, aliases, aliases))
    assert again == {1: (["js", "py"], None), 2: (["ml"], None), 3: ([], None), 4: ([], None), 5: ([], None), 6: (["py"], None), 7: (["ml"], None)}

    seen = []
    real = textmine.skill_hits
    monkeypatch.setattr(en, "skill_hits", lambda docs, *a, **k: seen.append(sorted(r["id"] for r in docs.select("id").collect())) or real(docs, *a, **k))
    changed = {**TEXTS, 3: "now Python", 8: "new javascript"}
    del changed[2]
    # One alias comes, one goes, one gets longer than an alias it overlaps.
    newer = taxonomy(spark, [PAIRS[0], PAIRS[1], ("react", "react native", None), ("ml", "machine learning systems", None)])[1]
    got = as_dict(en.refreshed(frame(spark, changed), stored, "id", "text", skills, newer, aliases))
    assert got == {1: (["js", "py"], None), 3: (["py"], "text"), 4: ([], None), 5: ([], None), 6: (["py", "react"], "alias"), 7: (["ml"], "alias"), 8: (["js"], "new")}
    assert seen == [[3, 6, 7, 8]]
    whole = {r["id"]: r.skills for r in en.extracted(frame(spark, changed), "id", "text", skills, newer).collect()}
    assert {k: v[0] for k, v in got.items()} == whole


def test_whole_documents_after_a_change_of_the_taxonomy(spark):
    from laborcast.plans import queries_text as q

    sf = "/root/testdata/sf0.001"
    docs, skills, aliases = q.documents(spark, sf), q.skills(spark, sf), q.aliases(spark, sf)
    older = aliases.where("alias NOT IN ('ai en', 'rewh')")
    stored = en.extracted(docs, "doc_id", "text", skills, older)
    got = en.refreshed(docs, stored, "doc_id", "text", skills, aliases, older).collect()
    whole = {r.doc_id: r.skills for r in en.extracted(docs, "doc_id", "text", skills, aliases).collect()}
    assert {r.doc_id: r.skills for r in got} == whole and 0 < sum(r.reason == "alias" for r in got) < len(got)
