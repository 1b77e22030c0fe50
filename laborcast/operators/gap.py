"""Skill gaps."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .taxonomy import non_skill_reasons, resolve_or_slug


def required_skills(role_skills: DataFrame, skills: DataFrame, lookup: DataFrame, non_skills: DataFrame) -> DataFrame:
    """Required skills of each role in order, resolved, without broad labels and repeats.

    ``role_skills`` is (target_role, skill_name, rank, weight).
    """
    labels = non_skill_reasons(role_skills, "skill_name", non_skills).select("skill_name")
    rows = role_skills.join(labels, "skill_name", "left_anti").join(resolve_or_slug(role_skills, "skill_name", lookup, skills), "skill_name")
    first = rows.groupBy("target_role", "skill_id").agg(
        F.min("rank").alias("rank"), F.min_by("display", "rank").alias("display"), F.max("in_taxonomy").alias("in_taxonomy"),
        F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("rank"))).alias("weight"))
    order = W.partitionBy("target_role").orderBy("rank")
    return first.withColumn("position", F.row_number().over(order) - 1)


# Fixed values
RANK_DECAY, TOP_RANKED = 0.15, 3
ADJACENT_CREDIT, COVERAGE_WEIGHT, EXPERIENCE_WEIGHT, SMOOTHING = 0.40, 0.85, 0.15, 1.0
MATCH_AT, ADJACENT_AT = 0.92, 0.82


def with_importance(required: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds importance, required level and priority (G02, G03, W06): an explicit weight, else decay by position."""
    explicit = F.col(weight).isNotNull()
    # greatest and least skip NULLs, so a missing weight must not reach them.
    clamped = F.when(explicit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight).cast("double"))))
    importance = F.coalesce(clamped, 1.0 / (1.0 + RANK_DECAY * F.col("position")))
    level = F.when(explicit, F.when(importance >= 0.85, 4).when(importance >= 0.70, 3).otherwise(2)) \
        .otherwise(F.when(F.col("position") < TOP_RANKED, 3).otherwise(2))
    priority = F.when(importance >= 0.80, "High").when(importance >= 0.60, "Medium").otherwise("Low")
    return required.select("*", importance.alias("importance"), level.alias("required_level"), priority.alias("priority"))


def first_weight_source(required: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Weights of the first source that a role has any weight in.

    ``sources`` are (label, rows of target_role, skill_id, weight) in order; adds ``weight`` and ``importance_source``.
    """
    rows = None
    for i, (label, df) in enumerate(sources):
        part = df.groupBy("target_role", "skill_id").agg(F.max("weight").alias("weight")).withColumn("_i", F.lit(i)).withColumn("importance_source", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("target_role").agg(F.min(F.struct("_i", "importance_source")).alias("_s"))
    used = rows.join(first, "target_role").where(F.col("_i") == F.col("_s._i")).select("target_role", "skill_id", "weight")
    out = required.drop("weight").join(used, ["target_role", "skill_id"], "left").join(first.select("target_role", "_s.importance_source"), "target_role", "left")
    any_hit = F.max(F.col("weight").isNotNull()).over(W.partitionBy("target_role"))
    return out.withColumn("importance_source", F.when(any_hit, F.col("importance_source")).otherwise("rank_decay"))


def skill_relations(skills: DataFrame, closure: DataFrame) -> DataFrame:
    """(required_id, have_id, rule): how having one skill bears on needing another.

    2 a finer skill covers a coarser one; 3 sibling or broader; 4 what the skill builds on; 5 what builds on it.
    """
    up = closure.select(F.col("id").alias("have_id"), F.col("ancestor"))
    selves = skills.select(F.col("id").alias("have_id"), F.col("id").alias("ancestor"))
    reach = up.unionByName(selves)
    parent = skills.where("maps_to IS NOT NULL").select(F.col("id").alias("required_id"), F.col("maps_to").alias("ancestor"))
    needs = skills.select(F.col("id").alias("required_id"), F.explode("prerequisites").alias("ancestor"))
    rules = up.select(F.col("ancestor").alias("required_id"), "have_id", F.lit(2).alias("rule")) \
        .unionByName(parent.join(reach, "ancestor").select("required_id", "have_id", F.lit(3).alias("rule"))) \
        .unionByName(needs.join(reach, "ancestor").select("required_id", "have_id", F.lit(4).alias("rule"))) \
        .unionByName(needs.select(F.col("ancestor").alias("required_id"), F.col("required_id").alias("have_id"), F.lit(5).alias("rule")))
    return rules.where("required_id <> have_id").groupBy("required_id", "have_id").agg(F.min("rule").alias("rule"))


def held_skills(profile: DataFrame) -> DataFrame:
    """(candidate_id, _held): the graded skills of each candidate as one map, no longer than the taxonomy. Its keys are 64-bit
    hashes of the ids, which are found several times faster than texts."""
    known = ["level", "needs_verification", "supported", *[c for c in ("claimed",) if c in profile.columns]]
    entry = F.struct(F.xxhash64("skill_id").alias("key"), F.struct((-F.col("level")).alias("a"), (-F.col("confidence")).alias("b"), *known).alias("h"))
    lists = profile.where("candidate_id IS NOT NULL AND skill_id IS NOT NULL").groupBy("candidate_id").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    first = F.filter("_all", lambda x, i: (i == 0) | (x["key"] != F.get("_all", i - 1)["key"]))
    return lists.select("candidate_id", F.map_from_entries(first).alias("_held"))


def role_needs(required: DataFrame, relations: DataFrame) -> DataFrame:
    """(target_role, _need): what each role requires as one list, each skill with the skills that bear on it as (rule, have_id, key)."""
    offers = relations.groupBy(F.col("required_id").alias("skill_id")).agg(F.collect_set(F.struct(F.col("rule").cast("int").alias("rule"), "have_id", F.xxhash64("have_id").alias("key"))).alias("_rules"))
    exact = F.array(F.struct(F.lit(1).alias("rule"), F.col("skill_id").alias("have_id"), F.xxhash64("skill_id").alias("key")))
    need = F.struct("skill_id", "display", "in_taxonomy", "position", "importance", "required_level", "priority", F.concat(exact, F.coalesce("_rules", F.slice(exact, 1, 0))).alias("offers"))
    return required.join(offers, "skill_id", "left").groupBy("target_role").agg(F.collect_list(need).alias("_need"))


def gap_rows(requests: DataFrame, required: DataFrame, profile: DataFrame, relations: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """One row per (candidate, role, required skill) with its match status.

    ``requests`` is (candidate_id, target_role); ``required`` from ``with_importance``; ``profile`` graded skills.
    ``similar`` optionally gives (candidate_id, target_role, skill_id, have_id, similarity) for skills no rule matched.

    A candidate's skills are one map and a role's needs one list, so a request meets each once and is matched inside its row:
    only profiles are shuffled, and the rows stay where their candidate is. The needs, one row per role, are broadcast.
    """
    rows = requests.select("candidate_id", "target_role").join(held_skills(profile), "candidate_id", "left").join(F.broadcast(role_needs(required, relations)), "target_role")

    def best(offers):
        met = F.transform(offers, lambda o: F.struct(o["rule"].alias("rule"), o["have_id"].alias("have_id"), F.try_element_at("_held", o["key"]).alias("h")))
        return F.array_min(F.transform(F.filter(met, lambda m: m["h"].isNotNull()), lambda m: F.struct(
            m["rule"].alias("rule"), m["h"]["a"].alias("a"), m["h"]["b"].alias("b"), m["have_id"].alias("have_id"), m["h"].alias("h"))))

    fields = ["skill_id", "display", "in_taxonomy", "position", "importance", "required_level", "priority"]
    matched = F.transform("_need", lambda n: F.struct(*[n[c].alias(c) for c in fields], best(n["offers"]).alias("_m")))
    # The outer form: the plain one makes the optimizer evaluate the lists twice.
    rows = rows.select("candidate_id", "target_role", F.inline_outer(matched))
    claimed = [F.col("_m.h.claimed").alias("via_claimed")] if "claimed" in profile.columns else []
    rule, via, level = F.col("_m.rule"), F.col("_m.have_id"), F.col("_m.h.level")
    reason = F.when(rule == 1, "exact").when(rule.isin(2, 3), "maps_to").when(rule.isin(4, 5), "prerequisite")
    status = F.when(rule <= 2, "matched").when(rule.isNotNull(), "adjacent").otherwise("missing")
    sim = F.lit(None).cast("double")
    if similar is not None:
        top = similar.groupBy("candidate_id", "target_role", "skill_id").agg(F.max_by(F.struct("have_id", "level", "similarity"), "similarity").alias("_s"))
        rows = rows.join(top, ["candidate_id", "target_role", "skill_id"], "left")
        use = rule.isNull() & F.col("_s").isNotNull()
        sim = F.when(use, F.round("_s.similarity", 3))
        status = F.when(use, F.when(F.col("_s.similarity") >= MATCH_AT, "matched").otherwise("adjacent")).otherwise(status)
        reason, via = F.when(use, "semantic").otherwise(reason), F.when(use, F.col("_s.have_id")).otherwise(via)
        level = F.when(use, F.col("_s.level")).otherwise(level)
    current = F.when(status == "matched", level).otherwise(0)
    return rows.select(
        "candidate_id", "target_role", "skill_id", "display", "in_taxonomy", "position", "importance", "required_level", "priority",
        status.alias("status"), reason.alias("reason"), via.alias("via"), rule.alias("rule"), sim.alias("similarity"), current.alias("current_level"),
        (F.col("required_level") - current).alias("gap"), F.when(status == "adjacent", level).alias("related_level"),
        F.coalesce("_m.h.needs_verification", F.lit(False)).alias("via_unverified"), F.col("_m.h.supported").alias("via_supported"), *claimed)


def gap_scores(gaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Coverage, experience factor and match score per (candidate, role).

    ``candidates`` is (candidate_id, target_role, experience_years, role_min, role_max).
    """
    credit = F.when(F.col("status") == "matched", F.least(F.lit(1.0), F.col("current_level") / F.col("required_level"))) \
        .when(F.col("status") == "adjacent", ADJACENT_CREDIT).otherwise(0.0)
    sums = gaps.groupBy("candidate_id", "target_role").agg((F.sum(F.col("importance") * credit) / F.sum("importance")).alias("coverage"))
    factor = F.least(F.lit(1.0), (F.col("experience_years") + SMOOTHING) / (F.col("role_min") + SMOOTHING))
    return candidates.join(sums, ["candidate_id", "target_role"]).select(
        "*", factor.alias("experience_factor"), F.round(COVERAGE_WEIGHT * F.col("coverage") + EXPERIENCE_WEIGHT * factor, 4).alias("match_score"))


def verdicts(scores: DataFrame, gaps: DataFrame, profile: DataFrame) -> DataFrame:
    """over_qualified / under_skilled / good_fit with the count of strong skills the role does not use."""
    strong = profile.where("level >= 3 AND candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.collect_list("skill_id").alias("_strong"))
    used = gaps.groupBy("candidate_id", "target_role").agg(F.collect_set("skill_id").alias("_asked"), F.collect_set("via").alias("_via"))
    rows = scores.join(used, ["candidate_id", "target_role"], "left").join(strong, "candidate_id", "left")
    unused = F.size(F.filter("_strong", lambda s: ~F.array_contains("_asked", s) & ~F.array_contains("_via", s)))
    rows = rows.withColumn("unused_strong", F.coalesce(F.when(F.col("_asked").isNotNull() & F.col("_strong").isNotNull(), unused), F.lit(0)).cast("long")).drop("_asked", "_via", "_strong")
    verdict = F.when((F.col("match_score") >= 0.85) & (F.col("experience_years") > F.col("role_max")) & (F.col("unused_strong") >= 3), "over_qualified") \
        .when(F.col("match_score") < 0.60, "under_skilled").otherwise("good_fit")
    return rows.withColumn("verdict", verdict)


def skill_buckets(gaps: DataFrame, skills: DataFrame) -> DataFrame:
    """Skill names by bucket, most important first; broad fields last among the missing."""
    rows = gaps.join(skills.select(F.col("id").alias("skill_id"), "is_category"), "skill_id", "left").fillna(False, ["is_category"])

    def bucket(keep, order, name: str):
        item = F.when(keep, F.struct(*order, F.col("position").alias("p"), "skill_id"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["skill_id"]).alias(name)

    heavy = [(-F.col("importance")).alias("i")]
    matched = F.col("status") == "matched"
    return rows.groupBy("candidate_id", "target_role").agg(
        bucket(matched & (F.col("gap") <= 0), heavy, "matched"), bucket(matched & (F.col("gap") > 0), heavy, "weak"),
        bucket(F.col("status") == "adjacent", heavy, "adjacent"), bucket(F.col("status") == "missing", [F.col("is_category").alias("c"), *heavy], "critical_missing"),
        bucket(matched & (F.col("gap") < 0), heavy, "above_requirement"))


def advice(gaps: DataFrame, profile: DataFrame, skills: DataFrame, children: DataFrame) -> DataFrame:
    """Gaps that come with a sentence of advice (G07). ``children`` from ``category_children``."""
    names = skills.select(F.col("id").alias("via"), F.col("display").alias("via_display"))
    concrete = children.join(skills.select(F.col("id").alias("child"), F.col("display").alias("child_display")), "child").groupBy(F.col("id").alias("skill_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "child_display"))), lambda x: x["child_display"]), ", ").alias("_children"))
    rows = gaps.join(names, "via", "left").join(skills.select(F.col("id").alias("skill_id"), "is_category"), "skill_id", "left") \
        .join(concrete, "skill_id", "left")
    if "via_claimed" in gaps.columns:
        rows = rows.withColumnRenamed("via_claimed", "claimed")
    else:
        rows = rows.join(profile.select("candidate_id", F.col("skill_id").alias("via"), "claimed"), ["candidate_id", "via"], "left")
    vd, d = F.coalesce("via_display", "via"), F.col("display")
    relation = F.when(F.col("reason") == "semantic", F.concat(F.lit("is similar to "), vd)).when(F.col("rule") == 3, F.concat(F.lit("is related to "), vd)) \
        .when(F.col("rule") == 4, F.concat(F.lit("builds on "), vd)).when(F.col("rule") == 5, F.concat(F.lit("is a foundation of "), vd))
    broad = F.coalesce("is_category", F.lit(False))
    note = F.when(F.col("_children").isNotNull(), F.concat(d, F.lit(" is a broad field, not a single skill. Concrete skills that build it: "), F.col("_children"), F.lit("."))) \
        .otherwise(F.concat(d, F.lit(" is a broad field, not a single skill, so it isn't added to the roadmap.")))
    text = (F.when(F.col("via_unverified"), F.concat(F.lit("You rate yourself level "), F.col("claimed").cast("string"), F.lit(" in "), vd,
                                                     F.lit(", but your resume doesn't show it yet. A project or certificate with "), d, F.lit(" would back that up.")))
            .when(broad, F.when(~((F.col("status") == "matched") & (F.col("gap") <= 0)), note))
            .when(F.col("via").isNull(), None)
            .when(~F.col("via_supported"), F.concat(F.lit("You list "), vd, F.lit(", but nothing in your work or projects shows it. Build a project with "), d, F.lit(".")))
            .when(F.col("status") == "adjacent", F.concat(d, F.lit(" "), relation, F.lit(", which you know, so it's a quick win."))))
    return rows.withColumn("advice", text).where("advice IS NOT NULL").select("candidate_id", "target_role", "skill_id", "advice")
