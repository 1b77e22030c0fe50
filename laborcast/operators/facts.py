"""Fact tables: posting volumes, skill demand, experience and salary distributions per occupation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.places import contains_any
from ..functions.titles import display_name
from .containment import contains_join, staged_join, two_way_join
from .ranks import floor_percentiles, frequency_top_k, top_k

# Fixed values
DEFAULT_YEAR = 2024
GENERIC_SKILLS = ["data", "backend", "frontend", "front_end", "automation", "coding", "software", "development",
                  "it software - application programming", "it software", "sales", "analytical", "computer science",
                  "data_analyst", "data_science", "data_engineering", "devops", "marketing", "production", "accounts",
                  "management", "business", "information technology", "engineering", "technical", "consulting",
                  "operations"]
# Fixed values: (words a title must have, words of which it needs one, phrase postings are searched for).
PHRASE_RULES = [
    (["data entry"], [], "data entry"),
    (["software"], ["dev", "eng"], "software"),
    (["machine learning"], [], "machine learning"),
    ([], ["data scientist", "data science"], "data scientist"),
    ([], ["customer service", "customer support"], "customer service"),
    (["nurse"], [], "nurse"),
    (["electrician"], [], "electrician"),
    (["accountant"], [], "accountant"),
    ([], ["telemarketer", "telecaller"], "telemarket"),
]
QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
METROS = [("Bengaluru", ["bengaluru", "bangalore"]), ("Hyderabad", ["hyderabad"]), ("Pune", ["pune"]),
          ("Mumbai", ["mumbai"]), ("Delhi NCR", ["delhi", "gurgaon", "noida", "ncr"])]
ZONE_EXPERIENCE = {1: (0.0, 1.0, 0.0, 0.5), 2: (1.0, 2.5, 0.5, 1.5), 3: (2.0, 4.5, 1.5, 3.0), 4: (3.0, 7.0, 2.5, 4.5),
                   5: (5.0, 10.0, 4.0, 6.5)}
DEFAULT_ZONE_EXPERIENCE = (1.0, 4.0, 1.0, 2.0)
DEFAULT_LPA = (8.5, 14.5, 22.0, 25)
DEFAULT_USD = (65000.0, 98000.0, 142000.0, 40)


# --- titles as search terms --------------------------------------------------------------------

def search_terms(df: DataFrame, title: str) -> DataFrame:
    """Adds the phrases a title is searched by: ``phrase``, ``first_word``, ``last_word`` and ``pattern``."""
    clean = F.trim(F.regexp_replace(F.lower(F.col(title)), r"[^a-z0-9\s]", ""))
    words = F.filter(F.split(F.col("phrase"), r"\s+"), lambda w: F.length(w) > 2)
    out = df.withColumn("phrase", clean).withColumn("_words", words)
    phrase = F.col("phrase")
    two = F.concat_ws(" ", F.get("_words", F.lit(0)), F.get("_words", F.lit(1)))
    pattern = F.when(F.size("_words") >= 2, two).when(F.size("_words") == 1, F.get("_words", F.lit(0))).otherwise(phrase)
    for needed, one_of, found in reversed(PHRASE_RULES):
        hit = reduce(lambda a, b: a & b, [phrase.contains(n) for n in needed], F.lit(True))
        pattern = F.when(hit & (contains_any(phrase, one_of) if one_of else F.lit(True)), found).otherwise(pattern)
    return out.withColumn("first_word", F.coalesce(F.get("_words", F.lit(0)), phrase)) \
        .withColumn("last_word", F.coalesce(F.try_element_at("_words", F.lit(-1)), phrase)) \
        .withColumn("pattern", pattern).drop("_words")


# --- posting volumes ----------------------------------------------------------------------------

def regional_years(postings: DataFrame) -> DataFrame:
    """Region x year: postings, employers and mean salaries; postings without a year count as 2024."""
    return postings.groupBy("region", F.coalesce("listed_year", F.lit(DEFAULT_YEAR)).alias("year")).agg(
        F.count(F.lit(1)).alias("total_postings"), F.count_distinct("company").alias("unique_employers"),
        F.avg("salary_min").alias("avg_salary_min"), F.avg("salary_max").alias("avg_salary_max"))


def matched_postings(terms: DataFrame, term: str, postings: DataFrame) -> DataFrame:
    """Postings whose lower-case title contains a term, one row per (term, posting)."""
    titled = postings.withColumn("_title", F.lower("title"))
    pairs = contains_join(terms, term, titled, "_title")
    return titled.join(pairs, "_title").drop("_title")


def posting_volumes(matched: DataFrame, term: str) -> DataFrame:
    """Per term and region: volume, employers, mean salaries and recency counts."""
    year = F.col("listed_year")
    return matched.groupBy(term, "region").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("company").alias("unique_companies"),
        F.avg((F.col("salary_min") + F.col("salary_max")) / 2).alias("avg_salary_mid"),
        F.avg("salary_min").alias("avg_salary_min"), F.avg("salary_max").alias("avg_salary_max"),
        F.count_if(year == 2024).alias("postings_2024"), F.count_if(year >= 2025).alias("postings_2025_plus"),
        F.count_if(year <= 2017).alias("historical_postings"), F.count_if(year >= 2024).alias("modern_postings"))


def top_places(matched: DataFrame, term: str, k: int = 5) -> DataFrame:
    """Per term and region: the k busiest places as "Place (count)" text, in order."""
    placed = matched.where(F.coalesce(F.col("city"), F.lit("")) != "")
    ranked = frequency_top_k(placed, [term, "region"], "city", k)
    label = F.format_string("%s (%d)", F.col("city"), F.col("cnt"))
    return ranked.groupBy(term, "region").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", label.alias("label")))), lambda x: x["label"]).alias("top_places"))


def yearly_counts(matched: DataFrame, term: str) -> DataFrame:
    """Per term, region and year: posting count."""
    return matched.where(F.col("listed_year").isNotNull()).groupBy(term, "region", F.col("listed_year").alias("year")) \
        .agg(F.count(F.lit(1)).alias("postings"))


# --- skill demand -------------------------------------------------------------------------------

def skill_comparison(mentions: DataFrame) -> DataFrame:
    """Skill x region: total demand and active years."""
    return mentions.groupBy("skill_normalized", "region").agg(
        F.sum("frequency").alias("total_demand"), F.count_distinct("year").alias("years_active"))


def context_pairs(roles: DataFrame, contexts: DataFrame) -> DataFrame:
    """(phrase, context) where either contains the other, for role phrases and lower-cased skill contexts."""
    lowered = contexts.select(F.lower("occupation_context").alias("context")).distinct()
    return two_way_join(roles.select("phrase"), "phrase", lowered, "context")


def demand_by_context(mentions: DataFrame) -> DataFrame:
    """Skill demand per context and region: everything downstream joins this, never the mentions."""
    return mentions.groupBy(F.lower("occupation_context").alias("context"), "region", "skill_normalized") \
        .agg(F.sum("frequency").alias("freq"))


def staged_skills(roles: DataFrame, mentions: DataFrame, keep: int = 40, sparse: int = 4) -> DataFrame:
    """Top ``keep`` skills per role and region from the first stage that is not sparse.

    Stage 1 takes contexts that contain the phrase or are contained in it; stage 2, used where stage 1 gives
    fewer than ``sparse`` skills, takes contexts containing the last word. Columns: role, region, stage,
    skill_normalized, freq, position.
    """
    demand = demand_by_context(mentions)
    pairs = staged_join(roles, demand, "context", two_way=True)
    freq = pairs.join(demand, "context") \
        .groupBy("role", "region", "stage", "skill_normalized").agg(F.sum("freq").alias("freq"))
    ranked = top_k(freq, ["role", "region", "stage"], [F.desc("freq"), F.asc("skill_normalized")], keep)
    found = ranked.withColumn("_n", F.count_if(F.col("stage") == 1).over(W.partitionBy("role", "region")))
    return found.where((F.col("stage") == 1) == (F.col("_n") >= sparse)).drop("_n")


def region_skills(mentions: DataFrame, keep: int = 40) -> DataFrame:
    """Top skills of a whole region: what a role without any context falls back to."""
    freq = mentions.groupBy("region", "skill_normalized").agg(F.sum("frequency").alias("freq"))
    return top_k(freq, ["region"], [F.desc("freq"), F.asc("skill_normalized")], keep)


def named_skills(ranked: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Drops generic words after the cut to ``keep``, then keeps the first ``limit``."""
    useful = ranked.where(~F.col("skill_normalized").isin(GENERIC_SKILLS)).drop("position")
    return top_k(useful, by, [F.desc("freq"), F.asc("skill_normalized")], limit)


def role_skills(roles: DataFrame, mentions: DataFrame, regions: list[str], limit: int = 8) -> DataFrame:
    """Top skills per role and region with the whole-region fallback."""
    staged = named_skills(staged_skills(roles, mentions), ["role", "region"], limit).select("role", "region", "skill_normalized", "freq", "position")
    wanted = roles.select("role", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"))
    lacking = wanted.join(staged.select("role", "region").distinct(), ["role", "region"], "left_anti")
    general = named_skills(region_skills(mentions), ["region"], limit)
    fallback = lacking.join(general, "region").select("role", "region", "skill_normalized", "freq", "position")
    return staged.unionByName(fallback)


def skill_weights(staged: DataFrame) -> DataFrame:
    """Share of a role's most frequent skill, both regions summed, generic words left out."""
    total = staged.where(~F.col("skill_normalized").isin(GENERIC_SKILLS)).groupBy("role", "skill_normalized").agg(F.sum("freq").alias("freq"))
    return total.withColumn("weight", F.round(F.col("freq") / F.max("freq").over(W.partitionBy("role")), 4))


def clean_mentions(mentions: DataFrame, noise: DataFrame) -> DataFrame:
    """Mentions whose skill is not noise, has no digit and is longer than one letter except c and r."""
    terms = noise.select(F.lower("term").alias("term")).distinct()
    skill = F.col("skill_normalized")
    kept = mentions.where(~skill.rlike("[0-9]") & ((F.length(skill) > 1) | skill.isin("c", "r")))
    return kept.join(terms, F.lower(kept.skill_normalized) == terms.term, "left_anti") \
        .join(terms, F.lower(kept.skill_name) == terms.term, "left_anti")


def skill_demand_by_code(clean: DataFrame, code_totals: DataFrame, *, min_mentions: int = 3, keep: int = 50) -> DataFrame:
    """Skill demand per code and region with its share of postings, at most ``keep`` skills each.

    ``code_totals`` is (soc_code, region, postings) from ``postings_per_code``.
    """
    grouped = clean.where(F.col("soc_code").isNotNull()).groupBy("soc_code", "region", "skill_normalized").agg(
        F.sum("frequency").alias("mentions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    joined = grouped.where(F.col("mentions") >= min_mentions).join(code_totals, ["soc_code", "region"], "left")
    total = F.greatest(F.col("mentions"), F.coalesce("postings", F.lit(0)), F.lit(1))
    named = joined.withColumn("posting_count", F.col("mentions")).withColumn("soc_posting_total", total) \
        .withColumn("share_of_postings", F.round(F.col("mentions") / total, 4)) \
        .withColumn("skill_name", display_name(F.col("skill_normalized"))) \
        .withColumn("source", F.concat("region", F.lit("_postings"))).drop("postings")
    return top_k(named, ["soc_code", "region"], [F.desc("posting_count"), F.asc("skill_normalized")], keep)


def postings_per_code(code_map: DataFrame) -> DataFrame:
    """Distinct postings per code and region."""
    return code_map.groupBy("soc_code", "region").agg(F.count_distinct("posting_id").alias("postings"))


def demand_importance(demand: DataFrame) -> DataFrame:
    """Importance of a skill relative to the code's most asked one, clamped to [0.2, 1]."""
    most = F.max("posting_count").over(W.partitionBy("soc_code", "region"))
    share = F.col("posting_count") / F.greatest(most, F.lit(1))
    return demand.withColumn("importance_norm", F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), share)), 4))


def add_curated(demand: DataFrame, curated: DataFrame) -> DataFrame:
    """Observed skills plus curated competencies; on a shared key the curated row wins."""
    rows = curated.select("soc_code", F.lit("curated").alias("region"), "skill_normalized", "skill_name",
                          F.lit(0).cast("long").alias("posting_count"), F.lit(None).cast("double").alias("share_of_postings"),
                          F.lit("curated").alias("source"))
    seen = demand.select(*rows.columns).withColumn("_order", F.lit(0)).unionByName(rows.withColumn("_order", F.lit(1)))
    return top_k(seen, ["soc_code", "region", "skill_normalized"], [F.desc("_order")], 1).drop("_order", "position")


# --- experience ---------------------------------------------------------------------------------

def experience_by_code(coded: DataFrame, occupations: DataFrame, *, since: int = 2023, min_sample: int = 30) -> DataFrame:
    """Experience band per code from recent postings; the job zone's default where the sample is small (A10).

    ``coded`` is (soc_code, experience_min, experience_max, listed_year); ``occupations`` (soc_code, job_zone).
    """
    recent = coded.where(F.col("experience_min").isNotNull() & (F.col("listed_year") >= since))
    basic = recent.groupBy("soc_code").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg("experience_min").alias("_min"), F.avg("experience_max").alias("_max"),
        F.avg(F.col("experience_min") + 3.0).alias("_open"),
        F.concat_ws("-", F.min("listed_year").cast("string"), F.max("listed_year").cast("string")).alias("years_covered"))
    ranks = floor_percentiles(recent, ["soc_code"], "experience_min", {"q25": 0.25, "q50": 0.50})
    joined = occupations.select("soc_code", "job_zone").join(basic, "soc_code", "left").join(ranks.drop("n"), "soc_code", "left")
    enough = F.coalesce(F.col("sample_size"), F.lit(0)) >= min_sample

    def default(i: int) -> Column:
        zones = F.create_map(*[F.lit(x) for z, v in ZONE_EXPERIENCE.items() for x in (z, v[i])])
        return F.coalesce(F.try_element_at(zones, F.col("job_zone")), F.lit(DEFAULT_ZONE_EXPERIENCE[i]))

    lo = F.greatest(F.lit(0.0), F.round("_min", 1))
    hi = F.greatest(lo + 1.0, F.round(F.coalesce("_max", "_open"), 1))
    return joined.select(
        "soc_code", F.when(enough, lo).otherwise(default(0)).alias("typical_min"), F.when(enough, hi).otherwise(default(1)).alias("typical_max"),
        F.when(enough, F.round("q25", 1)).otherwise(default(2)).alias("p25_min"),
        F.when(enough, F.round("q50", 1)).otherwise(default(3)).alias("median_min"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"), "years_covered", (~enough).cast("int").alias("fallback_to_job_zone"))


def experience_by_role(roles: DataFrame, postings: DataFrame, *, min_sample: int = 5) -> DataFrame:
    """Typical years per role from titles containing its phrase, else its last word, else 2-5."""
    known = postings.where(F.col("experience_min").isNotNull())
    per_title = known.groupBy("title_normalized").agg(
        F.count(F.lit(1)).alias("n"), F.sum("experience_min").alias("s_min"), F.sum("experience_max").alias("s_max"),
        F.count("experience_max").alias("n_max"))
    stages = staged_join(roles, per_title, "title_normalized", two_way=False).join(per_title, "title_normalized") \
        .groupBy("role", "stage").agg(F.sum("n").alias("n"), (F.sum("s_min") / F.sum("n")).alias("avg_min"),
                                      (F.sum("s_max") / F.nullif(F.sum("n_max"), F.lit(0))).alias("avg_max"))
    usable = stages.where(F.col("n") >= min_sample).groupBy("role").agg(F.min_by(F.struct("avg_min", "avg_max"), "stage").alias("b"))
    lo = F.greatest(F.lit(0.0), F.round("b.avg_min", 1))
    return roles.select("role").join(usable, "role", "left").select(
        "role", F.coalesce(lo, F.lit(2.0)).alias("experience_min"),
        F.when(lo.isNotNull(), F.greatest(lo + 1.0, F.round("b.avg_max", 1))).otherwise(F.lit(5.0)).alias("experience_max"))


# --- salary -------------------------------------------------------------------------------------

def salary_cube(coded: DataFrame) -> DataFrame:
    """Salary quartiles per code over the grouping sets city x experience, experience, city and neither.

    ``coded`` is (soc_code, city, city_canonical, experience_min, salary_min, salary_max, listed_year). Each row
    is expanded to its four cells, and the quartiles of all cells are found in one pass.
    """
    lpa = F.coalesce((F.col("salary_min") + F.col("salary_max")) / 200000.0, F.col("salary_min") / 100000.0)
    years = F.col("experience_min")
    rows = coded.where(F.coalesce("salary_min", "salary_max") > 100000).select(
        "soc_code", F.coalesce("city_canonical", F.lit("Other")).alias("_city"),
        F.when(years <= 2.5, "entry").when(years <= 6.0, "mid").otherwise("senior").alias("_band"),
        F.when(F.lower("city").contains("remote"), "remote").otherwise("onsite").alias("work_mode"),
        lpa.alias("lpa"), "listed_year").where(F.col("lpa").between(2.0, 120.0))
    cells = F.array(*[F.struct(c.alias("city_canonical"), b.alias("experience_bucket"))
                      for c in (F.col("_city"), F.lit("All India")) for b in (F.col("_band"), F.lit("all"))])
    keys = ["soc_code", "city_canonical", "experience_bucket", "work_mode"]
    expanded = rows.withColumn("_cell", F.explode(cells)).select("soc_code", "work_mode", "lpa", "listed_year", "_cell.*")
    spans = expanded.groupBy(*keys).agg(F.min("listed_year").alias("_from"), F.max("listed_year").alias("_to"))
    bands = floor_percentiles(expanded, keys, "lpa", QUARTILES).where(F.col("n") >= 2)
    covered = F.when(F.col("_from").isNull(), "2024-2026").otherwise(F.concat_ws("-", F.col("_from").cast("string"), F.col("_to").cast("string")))
    return bands.join(spans, keys).select(
        *keys, *[F.round(q, 1).alias(q) for q in QUARTILES], F.col("n").alias("sample_size"), covered.alias("years_covered"))


def band_labels(city: Column, years: Column) -> Column:
    """Every band a salary counts towards: remote alone, or overall, tiers (5-6 years in two) and metro."""
    low = F.lower(F.trim(F.coalesce(city, F.lit(""))))
    y = F.coalesce(years, F.lit(3.0))
    metro = F.lit(None).cast("string")
    for name, marks in reversed(METROS):
        metro = F.when(contains_any(low, marks), F.lit("city:" + name)).otherwise(metro)
    onsite = F.array(F.lit("onsite"), F.when(y <= 2.5, "exp:entry").when(y <= 6.0, "exp:mid"),
                     F.when(y >= 5.0, "exp:senior"), metro)
    return F.filter(F.when(low == "remote", F.array(F.lit("remote"))).otherwise(onsite), lambda b: b.isNotNull())


def salary_bands(roles: DataFrame, postings: DataFrame, *, min_rows: int = 5) -> DataFrame:
    """Salary quartiles in lakhs per role and band: onsite, remote, three tiers, five metros.

    Titles are matched both ways; a role with fewer than ``min_rows`` salaries is matched by its last word.
    """
    mid = F.coalesce((F.col("salary_min") + F.col("salary_max")) / 2.0, "salary_min", "salary_max")
    paid = postings.where(F.coalesce("salary_min", "salary_max") > 100000) \
        .select("title_normalized", "city", "experience_min", (mid / 100000.0).alias("lpa"))
    pairs = staged_join(roles, paid, "title_normalized", two_way=True)
    sizes = pairs.join(paid.groupBy("title_normalized").agg(F.count(F.lit(1)).alias("n")), "title_normalized") \
        .groupBy("role").agg(F.sum(F.when(F.col("stage") == 1, F.col("n"))).alias("_n"))
    chosen = pairs.join(sizes, "role").where((F.col("stage") == 1) == (F.coalesce("_n", F.lit(0)) >= min_rows)).select("role", "title_normalized")
    labelled = paid.where(F.col("lpa").between(2.0, 120.0)).join(chosen, "title_normalized") \
        .select("role", "lpa", F.explode(band_labels(F.col("city"), F.col("experience_min"))).alias("band"))
    bands = floor_percentiles(labelled, ["role", "band"], "lpa", QUARTILES)
    return bands.select("role", "band", *[F.round(q, 1).alias(q) for q in QUARTILES], F.col("n").alias("sample_size"))


def overall_band(roles: DataFrame, bands: DataFrame) -> DataFrame:
    """One overall band per role: onsite, else remote, else the fixed default."""
    best = bands.where(F.col("band").isin("onsite", "remote")).groupBy("role").agg(
        F.min_by(F.struct("p25", "p50", "p75", "sample_size"), "band").alias("b"))
    return roles.select("role").join(best, "role", "left").select("role", *[
        F.coalesce(F.col(f"b.{c}"), F.lit(d)).alias(c) for c, d in zip(["p25", "p50", "p75", "sample_size"], DEFAULT_LPA)])


def usd_bands(roles: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Dollar salary quartiles per role from the benchmarks, with the last-word stage and a default."""
    paid = benchmarks.where(F.col("salary_usd") > 15000).select("title_normalized", "salary_usd")
    pairs = staged_join(roles, paid, "title_normalized", two_way=True)
    first = pairs.groupBy("role").agg(F.min("stage").alias("stage"))
    rows = paid.join(pairs.join(first, ["role", "stage"]).select("role", "title_normalized"), "title_normalized")
    bands = floor_percentiles(rows, ["role"], "salary_usd", QUARTILES)
    return roles.select("role").join(bands, "role", "left").select(
        "role", *[F.coalesce(F.round(q, 1), F.lit(d)).alias(q) for q, d in zip(QUARTILES, DEFAULT_USD)],
        F.coalesce("n", F.lit(DEFAULT_USD[3]).cast("long")).alias("sample_size"))


def salary_benchmarks(postings: DataFrame) -> DataFrame:
    """Benchmark rows of postings in dollars: the global and the domestic rules side by side.

    ``postings`` is (region, title, title_normalized, country, salary_min_usd, salary_max_usd, salary_median_usd,
    experience_level, experience_min, employment_type, listed_year, source).
    """
    low, high, med = F.col("salary_min_usd"), F.col("salary_max_usd"), F.col("salary_median_usd")
    shared = ["source", "title", "title_normalized", "region"]
    world = postings.where((F.col("region") == "global") & (low.isNotNull() | med.isNotNull()) & (F.coalesce(med, low) > 5000)).select(
        *shared, "country", F.coalesce(med, (low + high) / 2.0, low).alias("salary_usd"), "experience_level", "employment_type",
        F.col("listed_year").alias("year"))
    years = F.col("experience_min")
    level = F.when(years >= 8, "Senior").when(years >= 3, "Mid-Level").when(years.isNotNull(), "Entry-Level")
    home = postings.where((F.col("region") == "india") & (F.coalesce(low, high) > 500)).select(
        *shared, F.lit("India").alias("country"), F.coalesce((low + high) / 2.0, low, high).alias("salary_usd"),
        level.alias("experience_level"), F.lit("Full-time").alias("employment_type"), F.col("listed_year").alias("year"))
    return world.unionByName(home)


def quality_flags(benchmarks: DataFrame, *, synthetic_source: str) -> DataFrame:
    """First matching quality problem of each benchmark row, sound rows left out (P10)."""
    home, pay = F.col("region") == "india", F.col("salary_usd")
    money = F.format_string("%.0f", pay)
    rules = [
        ((F.col("source") == synthetic_source) & home, "synthetic_source",
         F.lit("Compensation at global scale labelled as domestic")),
        (F.col("year") < 2023, "stale_pre_2023", F.format_string("Historical compensation point from year %d", F.col("year"))),
        (home & (pay < 1500), "monthly_suspected", F.concat(F.lit("Abnormally low annual salary ($"), money, F.lit(")"))),
        (home & (pay > 200000), "outlier", F.concat(F.lit("Extremely high domestic salary point ($"), money, F.lit(")"))),
    ]
    flag = reduce(lambda acc, r: F.when(r[0], F.struct(F.lit(r[1]).alias("flag"), r[2].alias("reason"))).otherwise(acc),
                  reversed(rules), F.lit(None))
    return benchmarks.withColumn("_f", flag).where(F.col("_f").isNotNull()).select("*", "_f.flag", "_f.reason").drop("_f")


def skill_demand(postings: DataFrame) -> DataFrame:
    """One row per skill a posting lists (O17). ``postings``: region, skills_text, listed_year, listed_month, context."""
    from ..functions.skill_text import skill_slug, split_skills

    rows = postings.where(F.coalesce("skills_text", F.lit("")) != "").select(
        "region", F.coalesce("listed_year", F.lit(DEFAULT_YEAR)).alias("year"), F.coalesce("listed_month", F.lit(1)).alias("month"),
        "occupation_context", F.explode(split_skills(F.col("skills_text"))).alias("skill_name")) \
        .withColumn("skill_normalized", skill_slug(F.col("skill_name"))).withColumn("frequency", F.lit(1))
    s = F.col("skill_normalized")
    return rows.where(((F.length(s) > 1) | s.isin("c", "r")) & (F.length(s) < 50))
