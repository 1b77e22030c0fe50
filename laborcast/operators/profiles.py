"""Candidate profiles: skill levels from evidence, claims, assembly."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.titles import word_slug
from .taxonomy import name_lookup, resolve_names
from .textmine import DATE_RANGE, education, merged_years, sections, skill_hits, work_history

# Evidence -> (base level, confidence), strongest first.
EVIDENCE = {"work_supported": (3, 0.90), "project_supported": (2, 0.75), "resume_mentioned": (1, 0.50), "self_reported": (1, 0.40)}
SECTION_EVIDENCE = {"experience": "work_supported", "projects": "project_supported"}
MAX_LEVEL, CLAIM_CAP = 4, 2


def evidence_levels(evidence: DataFrame) -> DataFrame:
    """Level and confidence per (candidate_id, skill_id) from kinds of evidence."""
    kind = F.col("evidence")
    rank = F.lit(len(EVIDENCE))
    for i, name in enumerate(EVIDENCE):
        rank = F.when(kind == name, i).otherwise(rank)
    best = F.min(rank)
    per = evidence.groupBy("candidate_id", "skill_id").agg(
        best.alias("_best"), F.max(kind == "work_supported").alias("_work"), F.max(kind == "project_supported").alias("_project"))
    table = list(EVIDENCE.values())
    base = F.get(F.array(*[F.lit(v[0]) for v in table]), F.col("_best"))
    confidence = F.get(F.array(*[F.lit(v[1]) for v in table]), F.col("_best"))
    both = F.col("_work") & F.col("_project")
    return per.select("candidate_id", "skill_id", F.least(base + both.cast("int"), F.lit(MAX_LEVEL)).alias("level"), confidence.alias("confidence"),
                      (F.col("_work") | F.col("_project")).alias("supported"))


def reconcile_claims(graded: DataFrame, claims: DataFrame) -> DataFrame:
    """Claimed levels against evidence: unsupported claims are capped and flagged, supported ones lift by one."""
    rows = graded.join(claims.select("candidate_id", "skill_id", F.col("claimed").cast("int").alias("claimed")), ["candidate_id", "skill_id"], "left")
    level, claimed, supported = F.col("level"), F.col("claimed"), F.col("supported")
    unbacked = claimed.isNotNull() & (claimed > level) & ~supported
    adjusted = F.when(unbacked, F.greatest(level, F.least(claimed, F.lit(CLAIM_CAP)))) \
        .when(claimed.isNotNull() & supported, F.greatest(level, F.least(claimed, level + 1))).otherwise(level)
    return rows.select("candidate_id", "skill_id", adjusted.cast("int").alias("level"), "confidence", "supported", "claimed",
                       (unbacked & (claimed > CLAIM_CAP)).alias("needs_verification"))


def typed_skills(typed: DataFrame, id_col: str, name: str, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Typed names as skills: by name, else by the mentions inside it, else kept as an unknown."""
    names = typed.where(F.trim(name) != "").select(F.trim(name).alias("name")).distinct()
    direct = resolve_names(names, "name", name_lookup(skills, aliases))
    rest = names.join(direct, "name", "left_anti")
    found = skill_hits(rest.withColumn("_text", F.col("name")), "name", "_text", skills, aliases, skills_context=F.lit(True)).select("name", "skill_id").distinct()
    unknown = rest.join(found.select("name").distinct(), "name", "left_anti") \
        .select("name", F.when(word_slug(F.col("name")) == "", "unknown").otherwise(word_slug(F.col("name"))).alias("skill_id"))
    known = direct.select("name", "skill_id").unionByName(found).withColumn("in_taxonomy", F.lit(True))
    resolved = known.unionByName(unknown.withColumn("in_taxonomy", F.lit(False)))
    return typed.withColumn("name", F.trim(name)).join(resolved, "name")


def resume_evidence(resumes: DataFrame, id_col: str, text: str, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, skill_id, evidence) from the section each mention stands in."""
    parts = sections(resumes, id_col, text)
    kept = F.filter(F.split("body", "\n"), lambda l: ~l.rlike(DATE_RANGE))
    body = F.when(F.col("section") == "experience", F.array_join(kept, "\n")).otherwise(F.col("body"))
    keyed = parts.select(F.struct(F.col(id_col).alias("id"), "section").alias("_key"), "section", body.alias("_body"))
    hits = skill_hits(keyed, "_key", "_body", skills, aliases, skills_context=F.col("section") == "skills")
    kind = F.when(F.col("_key.section") == "experience", "work_supported").when(F.col("_key.section") == "projects", "project_supported").otherwise("resume_mentioned")
    return hits.select(F.col("_key.id").alias("candidate_id"), "skill_id", kind.alias("evidence")).distinct()


def resume_facts(resumes: DataFrame, id_col: str, text: str, *, today: Column) -> DataFrame:
    """Experience and internship years and education lines per candidate, read from the text."""
    parts = sections(resumes, id_col, text)
    jobs = work_history(parts.where("section = 'experience'"), id_col, "body", today=today)
    years = merged_years(jobs, [id_col, "internship"])
    split = years.groupBy(id_col).agg(F.sum(F.when(~F.col("internship"), F.col("years"))).alias("experience_years"),
                                      F.sum(F.when(F.col("internship"), F.col("years"))).alias("internship_years"))
    degrees = education(parts.where("section = 'education'"), id_col, "body").groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(" ", "degree", "field").alias("e")))), lambda x: x["e"]).alias("education"))
    base = resumes.select(id_col, F.sha1(F.col(text).cast("binary")).alias("text_sha1"))
    out = base.join(split, id_col, "left").join(degrees, id_col, "left")
    return out.fillna(0.0, ["experience_years", "internship_years"]).withColumn("education", F.coalesce("education", F.array().cast("array<string>")))


def assemble(people: DataFrame, graded: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per candidate with its skills as structs, strongest first."""
    named = graded.join(skills.select(F.col("id").alias("skill_id"), "display"), "skill_id", "left")
    row = F.struct((-F.col("level")).alias("a"), (-F.col("confidence")).alias("b"), F.lower("display").alias("c"), "skill_id", "level", "confidence", "needs_verification")
    lists = named.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(
        x["skill_id"].alias("skill_id"), x["level"].alias("level"), x["confidence"].alias("confidence"), x["needs_verification"].alias("needs_verification"))).alias("skills"))
    return people.join(lists, "candidate_id")
