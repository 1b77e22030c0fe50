"""Candidate-to-job matching and job ranking over pairs that are worth comparing.

Pairs come from the caller: applications, or the markets that :mod:`best_matches` searches. Nothing here forms every
candidate-job combination. A job's skills are one list and a candidate's credits one map, both no longer than the taxonomy,
so a pair is scored inside its row and meets each side once.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.places import region_members
from ..functions.titles import POSTING_TITLE_BANDS, title_band, title_words
from .ranks import top_k

# Fixed values
MATCH_WEIGHTS = {"skills": 0.40, "experience": 0.20, "education": 0.10, "location": 0.10, "seniority": 0.10, "preference": 0.10}
RANK_WEIGHTS = {"match": 0.55, "location": 0.15, "experience": 0.10, "salary": 0.10, "recency": 0.10}
BROAD_SKILLS = ["ai", "data", "data_science", "big_data", "data_engineering", "generative_ai", "backend", "frontend", "frontend_development",
                "full_stack_development", "web_development", "mobile_development", "api_development", "devops", "automation", "cloud",
                "software_testing", "cybersecurity"]
SENIORITY = [(0, "intern|internship|trainee"), (1, "junior|jr|associate|graduate|fresher|entry"),
             (5, "principal|staff|head|director|architect|vp"), (4, "lead|manager"), (3, "senior|sr")]
DEGREES = [(3, r"\bph\.?\s?d\b|\bdoctorate\b"),
           (2, r"\bmaster'?s?\b|\bm\.?\s?tech\b|\bm\.?\s?e\b|\bm\.?\s?sc\b|\bmca\b|\bmba\b|\bpost.?graduate\b"),
           (1, r"\bbachelor'?s?\b|\bb\.?\s?tech\b|\bb\.?\s?e\b|\bb\.?\s?sc\b|\bbca\b|\bgraduate\b|\bdegree\b")]
NEUTRAL = 0.7
INFERRED_WEIGHT, BROAD_WEIGHT, INFERRED_PENALTY, RELATED_CREDIT = 0.5, 0.5, 0.3, 0.5
MIN_SKILLS, FILL_TO, MIN_SHARE, PROFILE_TOP, KEYWORD_TOP = 3, 5, 0.15, 15, 8
PAIR = ["candidate_id", "job_id"]
#: (skill, parent) whose places pairs carry instead of their names, and how many at most; all others travel by name.
Known = tuple[tuple[str, str | None], ...]
MOST_KNOWN = 512


def normalized(weights: dict[str, float] | None, default: dict[str, float]) -> dict[str, float]:
    chosen = {k: (weights or default).get(k, default[k]) for k in default}
    total = sum(chosen.values())
    return {k: v / total for k, v in chosen.items()}


# --- market profile -------------------------------------------------------------------------------

def market_profile(job_skills: DataFrame, by: list[str], *, k: int | None = PROFILE_TOP) -> DataFrame:
    """Share of a market's jobs asking for each skill, the ``k`` most asked (A18), or all of them without a position."""
    counts = job_skills.groupBy(*by, "skill_id").agg(F.count_distinct("job_id").alias("jobs"))
    totals = job_skills.groupBy(*by).agg(F.count_distinct("job_id").alias("jobs_analysed"))
    return (counts if k is None else top_k(counts, by, [F.desc("jobs"), F.asc("skill_id")], k)).join(totals, by) \
        .withColumn("share", F.round(F.col("jobs") / F.col("jobs_analysed"), 3))


def is_broad(skill: Column, flag: Column | None = None) -> Column:
    """The carried flag where there is one, else the fixed list."""
    listed = skill.isin(BROAD_SKILLS)
    return listed if flag is None else F.coalesce(flag, listed)


def concrete_children(profile: DataFrame, closure: DataFrame, by: list[str], broad: Column) -> DataFrame:
    """Concrete skills of a market at most two levels under each category, most asked first.

    ``profile`` should have every skill of the market, not only the most asked.
    """
    under = closure.where("depth <= 2").select(F.col("ancestor").alias("category"), F.col("id").alias("skill_id"))
    return profile.where(~broad).join(under, "skill_id").select(
        *by, "category", "skill_id", F.row_number().over(W.partitionBy(*by, "category").orderBy(F.desc("share"), F.desc("jobs"), F.asc("skill_id"))).alias("position"))


def infer_skills(jobs: DataFrame, job_skills: DataFrame, profile: DataFrame, broad: Column) -> DataFrame:
    """(job_id, role, skill_id, inferred): sparse jobs topped up from their role's profile.

    The common list per role is bounded by the profile's length, so each sparse job meets at most that many rows.
    """
    own = job_skills.select("job_id", "role", "skill_id").withColumn("inferred", F.lit(False))
    sizes = job_skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("skill_id").alias("_own"))
    common = profile.where((F.col("share") >= MIN_SHARE) & ~broad).groupBy("role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "skill_id"))), lambda x: x["skill_id"]).alias("_common"))
    sparse = jobs.select("job_id", "role").join(sizes, "job_id", "left").where(F.coalesce("_n", F.lit(0)) < MIN_SKILLS)
    have = F.coalesce("_own", F.array().cast("array<string>"))
    fill = F.slice(F.array_except("_common", have), F.lit(1), F.lit(FILL_TO) - F.size(have))
    added = sparse.join(common, "role").select("job_id", "role", F.explode_outer(fill).alias("skill_id")).where("skill_id IS NOT NULL") \
        .withColumn("inferred", F.lit(True))
    # The few added rows go back to their jobs, where the own ones are, so that a list of both needs no further shuffle.
    return own.unionByName(added.repartition("job_id"))


def skills_confidence(job_skills: DataFrame) -> DataFrame:
    """extracted / partly_inferred / inferred per job."""
    n = job_skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("inferred").alias("i"))
    return n.select("job_id", F.when(F.col("i") == 0, "extracted").when(F.col("i") == F.col("n"), "inferred").otherwise("partly_inferred").alias("skills_confidence"))


# --- skills ---------------------------------------------------------------------------------------

def _credit() -> Column:
    level = F.col("level")
    return F.when(level == 0, 0.0).when(level == 1, 0.6).when(level == 2, 0.8).otherwise(1.0) * F.when(F.col("needs_verification"), 0.5).otherwise(1.0)


def skill_credits(candidate_skills: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credit per candidate skill, and per parent of one."""
    direct = candidate_skills.groupBy("candidate_id", "skill_id").agg(F.max(_credit()).alias("credit"))
    parents = skills.where("maps_to IS NOT NULL").select(F.col("id").alias("skill_id"), "maps_to")
    via = direct.join(parents, "skill_id").groupBy("candidate_id", F.col("maps_to").alias("skill_id")).agg(F.max("credit").alias("via_credit"))
    return direct, via


def skill_rows(pairs: DataFrame, job_skills: DataFrame, credits: tuple[DataFrame, DataFrame], skills: DataFrame, broad: Column, *, known: Known = ()) -> DataFrame:
    """One row per pair and job skill with its weight and credit.

    A pair meets its job's list and its candidate's credits once; the rows are made where the credits are found, so none is shuffled.
    """
    direct, via = credits
    as_map = lambda rows, credit: F.map_from_entries(F.collect_list(F.struct("skill_id", credit)))
    own = direct.where("skill_id IS NOT NULL").groupBy("candidate_id").agg(as_map(direct, "credit").alias("credits"))
    above = via.where("skill_id IS NOT NULL").groupBy("candidate_id").agg(as_map(via, "via_credit").alias("via"))
    lists = item_lists(job_skills, skills, broad).select("job_id", "items")
    rows = pairs.join(with_places(lists, known), "job_id").join(with_credits(own.join(above, "candidate_id", "left"), known), "candidate_id", "left")
    # The places are few bytes, so they are made rows before names are looked up, in code that Spark compiles.
    found = F.explode_outer("_codes" if known else "items").alias("_x")
    each = rows.select(*PAIR, "credits", "via", found, *(["_others", "_by_place"] if known else []))
    item, given = (_item_of(known, F.col("_x")), _credit_of(F.col("_x"))) if known else (F.col("_x"), _item_credit(F.col("_x")))
    return each.select(*PAIR, *[item[f].alias(f) for f in ("skill_id", "parent", "inferred", "broad", "w")], given.alias("c"))


def skill_scores(rows: DataFrame) -> DataFrame:
    """Skill component per pair with matched and missing lists, concrete before broad, own before inferred."""
    item = F.struct("broad", "inferred", "skill_id")

    def names(keep: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, item))), lambda x: x["skill_id"])

    share = F.avg(F.col("inferred").cast("double"))
    return rows.groupBy(*PAIR).agg(
        (F.sum(F.col("w") * F.col("c")) / F.sum("w") * (1.0 - INFERRED_PENALTY * share)).alias("skills"),
        F.sum("w").alias("_w"), share.alias("_inferred"), names(F.col("c") > 0).alias("matched"), names(F.col("c") <= 0).alias("missing"))


def _total(items: str, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def item_lists(job_skills: DataFrame, skills: DataFrame, broad: Column) -> DataFrame:
    """(job_id, items, _w, _inferred): the skills of each job that has any with their weights, concrete before broad and own before
    inferred, the sum of the weights and the share of inferred skills."""
    facts = job_skills.join(skills.select(F.col("id").alias("skill_id"), F.col("maps_to").alias("parent"), "is_category"), "skill_id", "left")
    item = F.struct(broad.alias("broad"), "inferred", "skill_id", "parent", _weight(broad, F.col("inferred")).alias("w"))
    lists = facts.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("job_id", "items", _total("items", lambda x: x["w"]).alias("_w"),
                        (_total("items", lambda x: x["inferred"].cast("double")) / F.size("items")).alias("_inferred"))


def _weight(broad: Column, inferred: Column) -> Column:
    return F.when(inferred, INFERRED_WEIGHT).otherwise(1.0) * F.when(broad, BROAD_WEIGHT).otherwise(1.0)


def _item_credit(x: Column) -> Column:
    """The credit that a candidate's ``credits`` and ``via`` give for an item."""
    held = [F.nullif(F.try_element_at(m, x["skill_id"]), F.lit(0.0)) for m in ("credits", "via")]
    return F.coalesce(*held, F.try_element_at("credits", x["parent"]) * RELATED_CREDIT, F.lit(0.0))


def known_items(skills: DataFrame) -> Known:
    """(skill, parent) of the first skills of a taxonomy, which comes to the driver for it. With them a pair carries the places of
    its job's skills in this list; all others travel by name."""
    pairs = {(r["id"], r["maps_to"]) for r in skills.select("id", "maps_to").collect()}
    return tuple(sorted(pairs, key=lambda x: (x[0] or "", x[1] or ""))[:MOST_KNOWN])


def _names(known: Known) -> Column:
    text = lambda v: F.lit(v).cast("string")
    return F.array(*[F.struct(text(s).alias("skill_id"), text(p).alias("parent")) for s, p in known])


def with_places(lists: DataFrame, known: Known) -> DataFrame:
    """``lists`` with ``items`` replaced by _codes and _others, a few bytes for each skill: its place in ``known``, or less its
    place in _others, and in the last four bits its flags."""
    if not known:
        return lists
    name = lambda x: F.struct(x["skill_id"].alias("skill_id"), x["parent"].alias("parent"))
    flag = lambda b: F.when(b.isNull(), 2).otherwise(b.cast("int"))
    placed = lists.withColumn("_places", F.transform("items", lambda x: F.array_position(_names(known), name(x))))
    others = F.array_distinct(F.transform(F.filter("items", lambda x, i: F.get("_places", i) == 0), name))
    rows = placed.withColumn("_others", F.when(F.size(others) > 0, others))
    place = lambda x, i: F.when(F.get("_places", i) > 0, F.get("_places", i)).otherwise(-F.array_position("_others", name(x)))
    codes = F.transform("items", lambda x, i: (place(x, i) * 16 + flag(x["broad"]) * 4 + flag(x["inferred"])).cast("int"))
    return rows.withColumn("_codes", codes).drop("items", "_places")


def _code_parts(code: Column) -> tuple[Column, Column, Column]:
    """Place, broad and inferred of a code of :func:`with_places`."""
    truth = lambda shift: F.when(code.bitwiseAND(3 << shift) < (2 << shift), code.bitwiseAND(1 << shift) > 0)
    return F.shiftright(code, 4), truth(2), truth(0)


def _item_of(known: Known, code: Column) -> Column:
    place, broad, inferred = _code_parts(code)
    name = F.when(place > 0, F.get(_names(known), place - 1)).otherwise(F.get("_others", -place - 1))
    return F.struct(broad.alias("broad"), inferred.alias("inferred"), name["skill_id"].alias("skill_id"), name["parent"].alias("parent"), _weight(broad, inferred).alias("w"))


def with_credits(people: DataFrame, known: Known) -> DataFrame:
    """``people`` with _by_place, the credit of each of ``known``, so that pairs look up a place instead of names."""
    return people.withColumn("_by_place", F.transform(_names(known), _item_credit)) if known else people


def _credit_of(code: Column) -> Column:
    place = _code_parts(code)[0]
    return F.when(place > 0, F.coalesce(F.get("_by_place", place - 1), F.lit(0.0))).otherwise(_item_credit(F.get("_others", -place - 1)))


def _items_with_credits(rows: DataFrame, known: Known) -> tuple[Column, Column, Column]:
    """The items of rows of pairs, the weight of each, and the credit of each."""
    if not known:
        return F.col("items"), F.transform("items", lambda x: x["w"]), F.transform("items", _item_credit)

    def weight(code: Column) -> Column:
        _, broad, inferred = _code_parts(code)
        return _weight(broad, inferred)

    return F.transform("_codes", lambda c: _item_of(known, c)), F.transform("_codes", weight), F.transform("_codes", _credit_of)


def job_lists(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, broad: Column) -> DataFrame:
    """(job_id, items, _w, _inferred, text): each job's skills as in :func:`item_lists`.

    Jobs without skills have no items and, for the keyword fallback, their title and description as lower-case text.
    """
    lists = item_lists(job_skills, skills, broad)
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    return jobs.select("job_id", "title", "description").join(lists, "job_id", "left") \
        .select("job_id", "items", "_w", "_inferred", F.when(F.col("items").isNull(), text).alias("text"))


def credit_maps(candidate_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """(candidate_id, credits, via, top): credit per held skill and per parent of one, and the skills of the highest levels."""
    parents = skills.where("maps_to IS NOT NULL").select(F.col("id").alias("skill_id"), F.col("maps_to").alias("parent"))
    own = F.struct(F.lit(False).alias("up"), F.col("skill_id").alias("key"), _credit().alias("credit"), F.col("level").alias("level"))
    above = F.struct(F.lit(True).alias("up"), F.col("parent").alias("key"), _credit().alias("credit"), F.lit(0).alias("level"))
    rows = candidate_skills.join(parents, "skill_id", "left").select("candidate_id", F.inline_outer(F.array(own, above))).where("key IS NOT NULL")
    best = rows.groupBy("candidate_id", "up", "key").agg(F.max("credit").alias("credit"), F.max("level").alias("level"))
    entry, up = F.struct("key", "credit"), F.col("up")
    sides = best.groupBy("candidate_id").agg(F.collect_list(F.when(~up, entry)).alias("own"), F.collect_list(F.when(up, entry)).alias("above"),
                                             F.array_sort(F.collect_list(F.when(~up, F.struct((-F.col("level")).alias("order"), "key")))).alias("order"))
    return sides.select("candidate_id", F.map_from_entries("own").alias("credits"), F.map_from_entries("above").alias("via"),
                        F.slice(F.transform("order", lambda x: x["key"]), 1, KEYWORD_TOP).alias("top"))


def in_text(text: Column, skill: Column) -> Column:
    """Whether a skill's name stands in a lower-case text as a whole word (M07). A pattern is made only of names that the text contains."""
    name = F.replace(skill, F.lit("_"), F.lit(" "))
    return F.contains(text, name) & F.call_function("rlike", text, F.concat(F.lit("\\b\\Q"), name, F.lit("\\E\\b")))


def _skill_component(rows: DataFrame, credited: bool = False, known: Known = ()) -> DataFrame:
    """``rows`` of pairs with a job's items, _w, _inferred and text and a candidate's credits, via and top, replaced by the skill component.

    With ``credited`` the items stay, as a list of (skill_id, parent, inferred, w, c) with the credit of each. What depends on
    the job alone comes with it; a pair adds one credit per skill.
    """
    kept = [F.col(c) for c in rows.columns if c not in ("items", "text", "credits", "via", "top", "_w", "_inferred", "_codes", "_others", "_by_place")]
    bare = F.col("_codes" if known else "items").isNull()
    items, weights, credits = _items_with_credits(rows, known)

    found = F.filter("top", lambda s: in_text(F.col("text"), s))
    wide = rows.select(*kept, bare.alias("by_text"), items.alias("items"), "_w", "_inferred", weights.alias("_ws"), credits.alias("_c"),
                       "top", F.when(bare, found).alias("_found"))
    zero = F.lit(0.0)
    by_skills = F.aggregate(F.zip_with("_ws", "_c", lambda w, c: w * c), zero, lambda acc, x: acc + x) / F.col("_w") * (1.0 - INFERRED_PENALTY * F.col("_inferred"))
    by_text = F.coalesce(F.size("_found") / F.nullif(F.size("top"), F.lit(0)), zero)
    none = F.array().cast("array<string>")
    names = lambda keep: F.transform(F.filter("items", lambda x, i: keep(F.get("_c", i))), lambda x: x["skill_id"])
    fields = ("skill_id", "parent", "inferred", "w")
    listed = F.zip_with("items", "_c", lambda x, c: F.struct(*[x[f].alias(f) for f in fields], c.alias("c")))
    return wide.select(
        *kept, F.when(F.col("by_text"), by_text).otherwise(by_skills).alias("skills"), "_w", "_inferred",
        F.when(F.col("by_text"), F.coalesce("_found", none)).otherwise(names(lambda c: c > 0)).alias("matched"),
        F.when(F.col("by_text"), none).otherwise(names(lambda c: c <= 0)).alias("missing"), "by_text",
        *([listed.alias("credited")] if credited else []))


def pair_scores(pairs: DataFrame, lists: DataFrame, credits: DataFrame, *, known: Known = ()) -> DataFrame:
    """The skill component of every pair with matched and missing lists.

    Jobs without skills are scored by the share of the candidate's top skills that stand in their text as whole words (M07);
    what is found there is matched, and nothing is missing. With ``known`` (:func:`known_items`) pairs are smaller.
    """
    return _skill_component(pairs.join(with_places(lists, known), "job_id").join(with_credits(credits, known), "candidate_id", "left"), known=known)


# --- the other components -------------------------------------------------------------------------

def experience_band(requested: Column | None = None) -> Column:
    """Struct (min, max) of a job's years and where it comes from: posting, request, title, unknown."""
    lo, hi = F.col("experience_min"), F.col("experience_max")
    posted = F.when(lo.isNotNull(), F.struct(lo.alias("min"), F.greatest(F.coalesce(hi, lo + 3.0), lo).alias("max")))
    options = [posted] + ([requested] if requested is not None else []) + [title_band(F.col("title"), POSTING_TITLE_BANDS)]
    return F.coalesce(*options)


def experience_score(years: Column, band: Column) -> Column:
    lo, hi = band["min"], band["max"]
    return F.when(band.isNull(), NEUTRAL).when(years < lo, years / lo).when(years <= hi, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (years - hi) / 10.0))


def candidate_level(years: Column) -> Column:
    return F.when(years < 0.5, 0).when(years < 2, 1).when(years < 5, 2).when(years < 8, 3).when(years < 12, 4).otherwise(5)


def job_level(title: Column, band: Column) -> Column:
    """The level of a job: from its title words, else from its band; NULL if neither says anything."""
    named = reduce(lambda acc, r: F.when(title_words(title, r[1]), r[0]).otherwise(acc), reversed(SENIORITY), F.lit(None).cast("int"))
    return F.coalesce(named, F.when(band.isNotNull(), candidate_level(band["min"])))


def level_score(level: Column, years: Column) -> Column:
    """1 less 0.3 per level between the job and the candidate."""
    return F.when(level.isNull(), NEUTRAL).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.3 * F.abs(level - candidate_level(years))))


def degree_level(text: Column) -> Column:
    return reduce(lambda acc, r: F.when(F.lower(text).rlike(r[1]), r[0]).otherwise(acc), reversed(DEGREES), F.lit(0))


def wanted_degree(title: Column, description: Column) -> Column:
    """The degree that a job's description mentions, else its title; 0 for none."""
    return F.when(degree_level(description) > 0, degree_level(description)).otherwise(degree_level(title))


def held_degree(education: Column) -> Column:
    """The highest degree among a candidate's; 0 for none."""
    return F.coalesce(F.array_max(F.transform(education, degree_level)), F.lit(0))


def degree_score(have: Column, wanted: Column) -> Column:
    """1 when the candidate's highest degree meets what the job mentions, else 0.6, or 0.4 without one."""
    return F.when(wanted == 0, 1.0).when(have >= wanted, 1.0).when(have > 0, 0.6).otherwise(0.4)


def location_score(mode: Column, location: Column, cities: Column) -> Column:
    """1 remote or same city, 0.8 same region (J19), 0.3 elsewhere, 0.7 unknown."""
    near = F.arrays_overlap(region_members(location), cities)
    return (F.when((mode == "remote") | (location == "Remote"), 1.0).when(location.isNull() | (F.size(cities) == 0), NEUTRAL)
            .when(F.array_contains(cities, location), 1.0).when(near, 0.8).otherwise(0.3))


def preference_score(modes: list[str], types: list[str], min_lpa: float | None) -> Column:
    """Mean of the preferences that were given; 1 without any."""
    parts = []
    for column, wanted in (("work_mode", modes), ("employment_type", types)):
        if wanted:
            parts.append(F.when(F.col(column).isin(wanted), 1.0).when(F.col(column) == "unknown", NEUTRAL).otherwise(0.0))
    if min_lpa:
        top = F.coalesce("salary_max", "salary_min")
        parts.append(F.when(top.isNull() | F.col("salary_is_predicted"), NEUTRAL).when(top >= min_lpa * 100_000, 1.0).otherwise(0.3))
    return reduce(lambda a, b: a + b, parts) / float(len(parts)) if parts else F.lit(1.0)


def match_class(overall: Column) -> Column:
    return F.when(overall >= 0.80, "Strong").when(overall >= 0.65, "Good").when(overall >= 0.45, "Partial").otherwise("Weak")


def job_facts(jobs: DataFrame, *, work_modes: list[str] = (), employment_types: list[str] = (), min_lpa: float | None = None,
              requested: Column | None = None) -> DataFrame:
    """``jobs`` with what the components read from a job alone: band, _level, _wanted and preference. Texts are read once per job, not per pair."""
    return jobs.withColumn("band", experience_band(requested)).select(
        "*", job_level(F.col("title"), F.col("band")).alias("_level"), wanted_degree(F.col("title"), F.col("description")).alias("_wanted"),
        preference_score(list(work_modes), list(employment_types), min_lpa).alias("preference"))


def candidate_facts(candidates: DataFrame) -> DataFrame:
    """``candidates`` with _degree, the highest degree they hold."""
    return candidates.withColumn("_degree", held_degree(F.col("education")))


def _components(rows: DataFrame) -> DataFrame:
    years, band = F.col("experience_years"), F.col("band")
    return rows.select(
        "*", experience_score(years, band).alias("experience"), degree_score(F.col("_degree"), F.col("_wanted")).alias("education_match"),
        location_score(F.col("work_mode"), F.col("location"), F.col("cities")).alias("location_match"),
        level_score(F.col("_level"), years).alias("seniority")).drop("_level", "_wanted", "_degree")


def components(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, **wishes) -> DataFrame:
    """The five components beside skills per pair, with the columns of both sides (M08-M12); ``wishes`` go to :func:`job_facts`.

    ``candidates`` has (candidate_id, experience_years, education array, cities array).
    """
    return _components(pairs.join(job_facts(jobs, **wishes), "job_id").join(candidate_facts(candidates), "candidate_id"))


def overall_score(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the six components, not yet rounded."""
    w = normalized(weights, MATCH_WEIGHTS)
    return (F.col("skills") * w["skills"] + F.col("experience") * w["experience"] + F.col("education_match") * w["education"]
            + F.col("location_match") * w["location"] + F.col("seniority") * w["seniority"] + F.col("preference") * w["preference"])


def classified(parts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return parts.withColumn("overall", F.round(overall_score(weights), 4)).withColumn("match_class", match_class(F.col("overall")))


def match_pairs(scored: DataFrame, jobs: DataFrame, candidates: DataFrame, *, weights: dict[str, float] | None = None, **wishes) -> DataFrame:
    """Six components, overall score and class per pair (M08-M13); ``scored`` has the pair and ``skills``, ``wishes`` go to :func:`components`."""
    return classified(components(scored, jobs, candidates, **wishes), weights)


def scored_matches(pairs: DataFrame, jobs: DataFrame, lists: DataFrame, candidates: DataFrame, credits: DataFrame, *,
                   weights: dict[str, float] | None = None, credited: bool = False, known: Known = (), **wishes) -> DataFrame:
    """:func:`match_pairs` of :func:`pair_scores`, where a pair meets each side once: all of a job is one row and all of a candidate another."""
    offers = job_facts(jobs, **wishes).join(with_places(lists, known), "job_id")
    people = candidate_facts(candidates).join(with_credits(credits, known), "candidate_id", "left")
    rows = pairs.join(offers, "job_id").join(people, "candidate_id")
    return classified(_components(_skill_component(rows, credited, known)), weights)


# --- ranking --------------------------------------------------------------------------------------

def salary_attractiveness(median: Column) -> Column:
    """0.5 at the market median, 1 at double it, 0.5 where nothing usable is posted."""
    lo, hi = F.col("salary_min"), F.col("salary_max")
    mid = (F.coalesce(lo, hi) + F.coalesce(hi, lo)) / 2.0
    usable = ~F.col("salary_is_predicted") & median.isNotNull() & mid.isNotNull()
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (mid - median) / (2.0 * median)))).otherwise(0.5)


def recency(now: Column) -> Column:
    """1 up to 3 days, falling to 0.2 by 45, 0.5 unknown, lower for stale snapshots."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 86_400e6
    score = F.when(F.col("posted_at").isNull(), 0.5).when(days <= 3, 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - 0.8 * (days - 3) / 42.0))
    return score * F.when(F.col("stale"), 0.8).otherwise(1.0)


def rank_score(match: Column, salary: Column, fresh: Column) -> Column:
    """The weighted sum of the five parts of a rank, not yet rounded."""
    parts = {"match": match, "location": F.col("location_match"), "experience": F.col("experience"), "salary": salary, "recency": fresh}
    return reduce(lambda a, b: a + b, [parts[n] * w for n, w in RANK_WEIGHTS.items()])


def rank_order() -> list[Column]:
    return [F.desc("rank_score"), F.desc("overall"), F.desc_nulls_last("posted_at"), F.asc("job_id")]


def rank_facts(jobs: DataFrame, median: Column, now: Column) -> DataFrame:
    """``jobs`` with salary_score and recency_score, the parts of a rank that depend on the job alone; pairs then carry these only."""
    return jobs.select("*", salary_attractiveness(median).alias("salary_score"), recency(now).alias("recency_score"))


def rank_jobs(matches: DataFrame, median: Column, now: Column, *, k: int | None = None) -> DataFrame:
    """Rank score per pair and, with ``k``, each candidate's best jobs in order (M16, T06). ``median`` is that of the job's market; with
    the columns of :func:`rank_facts` it isn't read."""
    if "salary_score" not in matches.columns:
        matches = rank_facts(matches, median, now)
    salary, fresh = F.col("salary_score"), F.col("recency_score")
    out = matches.select("*", F.round(rank_score(F.col("overall"), salary, fresh), 4).alias("rank_score"))
    return top_k(out, ["candidate_id"], rank_order(), k) if k else out


def skill_unlocks(matches: DataFrame, rows: DataFrame, wanted: DataFrame, *, weight: float = MATCH_WEIGHTS["skills"]) -> DataFrame:
    """Per candidate and wanted skill: jobs that would reach Good or better with it at a working level.

    Only the job skills the new one touches change, so the new score is the old one plus their gain.
    ``wanted`` is (candidate_id, skill_id), at most three per candidate.
    """
    want = wanted.select("candidate_id", F.col("skill_id").alias("unlock"))
    below = matches.where(~F.col("match_class").isin("Good", "Strong")).select(*PAIR, "overall", "_w", "_inferred")
    touched = rows.join(want, "candidate_id").where((F.col("skill_id") == F.col("unlock")) | ((F.col("parent") == F.col("unlock")) & (F.col("c") == 0)))
    better = F.when(F.col("skill_id") == F.col("unlock"), F.lit(1.0)).otherwise(RELATED_CREDIT)
    gains = touched.groupBy(*PAIR, "unlock").agg(F.sum(F.col("w") * F.greatest(better - F.col("c"), F.lit(0.0))).alias("_gain"))
    moved = below.join(gains, PAIR).withColumn("new", F.round(F.col("overall") + weight * F.col("_gain") / F.col("_w") * (1.0 - INFERRED_PENALTY * F.col("_inferred")), 4))
    return moved.where("new >= 0.65").groupBy("candidate_id", "unlock").agg(F.count(F.lit(1)).alias("jobs_unlocked"))


def unlocked_jobs(pairs: DataFrame, jobs: DataFrame, items: DataFrame, candidates: DataFrame, credits: DataFrame, wanted: DataFrame, *,
                  weight: float = MATCH_WEIGHTS["skills"], known: Known = ()) -> DataFrame:
    """:func:`skill_unlocks` of the pairs whose jobs have skills, with each pair's gains found in its row.

    ``items`` comes from :func:`item_lists`. A skill that a candidate wants twice gains twice, as there.
    """
    wants = wanted.groupBy("candidate_id").agg(F.collect_list("skill_id").alias("_wants"))
    scored = scored_matches(pairs, jobs, items.withColumn("text", F.lit(None).cast("string")), candidates.join(wants, "candidate_id"), credits, credited=True, known=known)
    below = scored.where(~F.col("match_class").isin("Good", "Strong"))

    def gain(u: Column) -> Column:
        def of(x: Column) -> Column:
            own = x["skill_id"] == u
            touched = own | ((x["parent"] == u) & (x["c"] == 0))
            return F.when(touched, x["w"] * F.greatest(F.when(own, F.lit(1.0)).otherwise(RELATED_CREDIT) - x["c"], F.lit(0.0))).otherwise(0.0)

        return F.aggregate("credited", F.lit(0.0), lambda acc, x: acc + of(x)) * F.size(F.filter("_wants", lambda y: y == u))

    gains = F.transform(F.array_distinct("_wants"), lambda u: F.struct(u.alias("unlock"), gain(u).alias("_gain")))
    moved = below.select("candidate_id", "overall", "_w", "_inferred", F.inline_outer(gains)) \
        .withColumn("new", F.round(F.col("overall") + weight * F.col("_gain") / F.col("_w") * (1.0 - INFERRED_PENALTY * F.col("_inferred")), 4))
    return moved.where("new >= 0.65").groupBy("candidate_id", "unlock").agg(F.count(F.lit(1)).alias("jobs_unlocked"))


def unlock_candidates(profile: DataFrame, candidates: DataFrame, held: DataFrame, broad: Column, *, k: int = 3) -> DataFrame:
    """The first ``k`` concrete skills of a candidate's market they do not have."""
    offers = candidates.select("candidate_id", "role").join(profile.where(~broad).select("role", "skill_id", F.col("position").alias("_p")), "role")
    return top_k(offers.join(held.select("candidate_id", "skill_id"), ["candidate_id", "skill_id"], "left_anti"), ["candidate_id"], [F.asc("_p")], k) \
        .select("candidate_id", "skill_id")


def top_match_mean(ranked: DataFrame, *, k: int = 5) -> DataFrame:
    """Mean match of each candidate's ``k`` best ranked jobs."""
    best = ranked.where(F.col("position") <= k)
    return best.groupBy("candidate_id").agg(F.avg("overall").alias("mean_match"))
