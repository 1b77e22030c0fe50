"""Occupation analytics: demand, task exposure, growth, outlook, trajectories, ranking, evidence and graph."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import dense_rank_positions, top_k

# Words that mark routine, analytical and hands-on tasks.
AUTOMATION_WORDS = [
    "record", "transcribe", "compile", "calculate", "enter data", "format", "schedule", "proofread", "file", "sort",
    "routine", "template", "standardized", "inspect document", "reconcile", "collate", "tabulate", "dispatch", "type",
    "keyboard", "billing", "invoicing", "copy", "logs", "telemarket", "dial", "cold call", "switchboard", "ticket",
    "form", "routine verification", "data entry"]
AUGMENTATION_WORDS = [
    "analyze", "design", "develop", "model", "program", "code", "evaluate", "synthesize", "forecast", "optimize",
    "troubleshoot", "review", "test", "diagnose", "investigate", "architect", "simulate", "benchmark", "configure",
    "machine learning", "algorithm", "statistical", "strategy", "roadmap"]
HUMAN_WORDS = [
    "negotiate", "persuade", "counsel", "empathy", "mentor", "lead", "manage conflict", "physical", "install", "repair",
    "operate machinery", "surgery", "therapy", "collaborate with client", "interview", "care", "inspect physically",
    "supervise people", "wire", "wiring", "conduit", "ladder", "scaffold", "assemble", "fixture", "cable", "circuit",
    "machinery", "pipe", "equipment", "construction", "weld", "carpentry", "motor", "tool", "hand tools", "power tools",
    "patient", "bedside", "vital signs", "medication", "clinical", "triage", "nurse", "nursing", "wound",
    "rehabilitation", "dressing", "physical exam", "vehicle", "drive", "plumb", "cook"]
# Title words of trades, clinical work and clerical work.
TRADE_TITLES = ["electrician", "carpenter", "plumber", "machinist", "mechanic", "welder", "construction", "mason",
                "painter", "roofer", "driver", "chef", "cook", "technician", "hvac", "assembler", "maintenance"]
CLINICAL_TITLES = ["nurse", "nursing", "physician", "surgeon", "dentist", "dental", "therapist", "paramedic",
                   "veterinarian", "radiologic", "phlebotomist"]
CLERICAL_TITLES = ["data entry", "telemarketer", "telecaller", "typist", "switchboard", "proofreader", "file clerk",
                   "mail clerk", "word processor", "teller", "billing clerk", "keyer"]
HUMAN, AUTOMATION = "Human-Centric / High Discretion", "Direct Automation"
AUGMENTATION, MODERATE = "AI Augmentation", "Moderate Transformation"
DEFAULT_WEIGHTS = {"current_demand": 0.30, "growth": 0.30, "ai_resilience": 0.20, "salary_level": 0.10, "confidence": 0.10}
MAX_VOLUME = {"india": 5000.0, "global": 10000.0, "all": 15000.0}


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(value, F.lit(hi)))


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


# --- demand -------------------------------------------------------------------------------------

def demand_scores(history: DataFrame, *, region: str = "all") -> DataFrame:
    """Adds demand signals to one row per occupation.

    ``history`` has g_/i_ totals, companies and place arrays plus g_2024, g_2025 and i_modern. A regional scope
    still counts both regions' employers and recent postings.
    """
    vol = {"india": F.col("i_total"), "global": F.col("g_total")}.get(region, F.col("g_total") + F.col("i_total"))
    companies = F.col("g_companies") + F.col("i_companies")
    recent = F.col("i_modern") + F.col("g_2024") + F.col("g_2025")
    places = F.size("i_places") + F.size("g_places")
    has = vol > 0
    volume = F.when(has, F.least(F.log1p(vol) / F.log1p(F.lit(MAX_VOLUME[region])), F.lit(1.0))).otherwise(0.15)
    spread = F.when(has, F.least(companies / (vol * 0.4 + 1.0), F.lit(1.0))).otherwise(0.50)
    velocity = F.when(has, F.least(recent / F.nullif(vol, F.lit(0)) * 1.2, F.lit(1.0))).otherwise(0.50)
    geo = F.least(places / 8.0, F.lit(1.0))
    score = clamp(F.round(volume * 0.40 + spread * 0.25 + velocity * 0.20 + geo * 0.15, 2), 0.10, 0.98)
    return history.select(
        "*", score.alias("current_demand_score"), F.round(volume, 2).alias("volume_score"),
        F.round(spread, 2).alias("employer_diversification"), F.round(velocity, 2).alias("velocity_ratio"),
        vol.alias("total_postings"), companies.alias("unique_employers"))


# --- task exposure ------------------------------------------------------------------------------

def task_exposure(tasks: DataFrame, text: str = "task_description") -> DataFrame:
    """Adds ``ai_impact_score`` and ``transformation_type`` from keyword counts."""
    low = F.lower(F.col(text))
    counted = tasks.select("*", _hits(low, AUTOMATION_WORDS).alias("_auto"), _hits(low, AUGMENTATION_WORDS).alias("_aug"),
                           _hits(low, HUMAN_WORDS).alias("_human"))
    auto, aug, human = F.col("_auto"), F.col("_aug"), F.col("_human")
    manual = (human > 0) & (human >= auto) & (human >= aug)
    score = (F.when(manual, clamp(0.25 - human * 0.04, 0.08, 0.35))
             .when(auto > aug, F.least(0.75 + auto * 0.06, F.lit(0.96)))
             .when((aug >= auto) & (aug > 0), F.least(0.40 + aug * 0.06, F.lit(0.75)))
             .when(human > 0, F.greatest(F.lit(0.10), 0.28 - human * 0.04)).otherwise(0.30))
    kind = (F.when(manual, HUMAN).when(auto > aug, AUTOMATION).when((aug >= auto) & (aug > 0), AUGMENTATION)
            .when(human > 0, HUMAN).otherwise(MODERATE))
    return counted.select(*tasks.columns, F.round(score, 2).alias("ai_impact_score"), kind.alias("transformation_type"))


def exposure_by_code(scored: DataFrame) -> DataFrame:
    """Mean task score and task counts per class for each code."""
    kind = F.col("transformation_type")
    return scored.groupBy("soc_code").agg(
        F.count(F.lit(1)).alias("task_count"), F.avg("ai_impact_score").alias("mean_exposure"),
        F.count_if(kind == AUTOMATION).alias("automated"), F.count_if(kind == AUGMENTATION).alias("augmented"),
        F.count_if(kind == HUMAN).alias("human_centric"), F.count_if(kind == MODERATE).alias("moderate"))


def occupation_exposure(occupations: DataFrame, exposure: DataFrame) -> DataFrame:
    """Calibrated exposure and its tier per occupation; title defaults where no task is known."""
    low = F.lower("title")
    trade, clinical, clerical = _has(low, TRADE_TITLES), _has(low, CLINICAL_TITLES), _has(low, CLERICAL_TITLES)
    mean = F.col("mean_exposure")
    scaled = (F.when(trade, F.least(mean * 0.55, F.lit(0.22))).when(clinical, F.least(mean * 0.58, F.lit(0.25)))
              .when(clerical, F.greatest(mean * 1.35, F.lit(0.82))).otherwise(mean))
    known = clamp(F.round(scaled, 2), 0.08, 0.95)
    default = F.when(trade | clinical, 0.16).when(clerical, 0.84).otherwise(0.40)
    score = F.when(F.col("task_count").isNotNull(), known).otherwise(default)
    out = occupations.join(exposure, "soc_code", "left").withColumn("ai_exposure_score", score)
    tier = F.when(F.col("ai_exposure_score") < 0.35, "Low").when(F.col("ai_exposure_score") <= 0.65, "Moderate").otherwise("High")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("task_count", "automated", "augmented", "human_centric", "moderate")]
    return out.select(*occupations.columns, "ai_exposure_score", F.concat(tier, F.lit(" transformation exposure")).alias("exposure_category"), *counts)


def sample_tasks(scored: DataFrame, order: str, k: int = 5) -> DataFrame:
    """First ``k`` scored tasks of a code in load order."""
    return top_k(scored, ["soc_code"], [F.asc(order)], k)


# --- forecast -----------------------------------------------------------------------------------

def growth(df: DataFrame) -> DataFrame:
    """Adds growth score, confidence and outlook (O04, O05, O06) to demand and exposure rows."""
    ai, total = F.col("ai_exposure_score"), F.col("g_total") + F.col("i_total")
    pull = F.when(ai >= 0.65, -(ai - 0.50) * 0.85).when(ai <= 0.30, (0.30 - ai) * 0.20).otherwise((0.50 - ai) * 0.25)
    recent = F.col("i_modern") + F.col("g_2024") + F.col("g_2025")
    momentum = F.least(recent / F.greatest(total, F.lit(1)), F.lit(1.0)) * 0.15
    score = clamp(F.round(F.col("current_demand_score") * 0.70 + pull + momentum, 2), 0.10, 0.98)
    volume = F.when(total > 0, F.least(total / 800.0, F.lit(0.45))).otherwise(0.10)
    tasks = F.when(F.col("task_count") > 0, 0.30).otherwise(0.10)
    regions = F.when((F.col("g_total") > 0) & (F.col("i_total") > 0), 0.15).otherwise(0.05)
    confidence = F.least(F.round(volume + tasks + regions + 0.10, 2), F.lit(0.95))
    out = df.select("*", score.alias("growth_score"), confidence.alias("confidence_score"))
    g, c = F.col("growth_score"), F.col("confidence_score")
    outlook = (F.when((g >= 0.75) & (c >= 0.55), "Strong Growth").when(g >= 0.55, "Moderate Growth")
               .when((g <= 0.35) | ((g <= 0.45) & (ai >= 0.65)), "Declining Demand")
               .when(ai >= 0.65, "Transforming (High AI Exposure)").when(g >= 0.40, "Stable Demand").otherwise("Emerging / Evolving"))
    return out.withColumn("outlook", outlook)


def damped_index(start: Column, rate: Column, steps: Column, damping: float = 0.90) -> Column:
    """start * prod(1 + rate * damping^k) for k = 1..steps."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start,
                       lambda acc, k: acc * (1.0 + rate * F.pow(F.lit(damping), k)))


def trajectory(df: DataFrame) -> DataFrame:
    """One row per occupation and year 2021-2031: indices with bounds, base 100 in 2024."""
    rate = (F.col("growth_score") - 0.50) * 0.25
    home_rate, demand, year = rate * 1.15, F.col("current_demand_score"), F.col("year")
    falling = rate < 0
    # Fixed values: (year, falling base, falling slope, rising base, rising slope).
    past = [(2021, 1.18, 0.08, 0.65, 0.15), (2022, 1.12, 0.06, 0.76, 0.14), (2023, 1.06, 0.03, 0.88, 0.12)]
    multiplier = F.lit(None).cast("double")
    for y, fb, fs, rb, rs in past:
        multiplier = F.when(year == y, F.when(falling, fb + demand * fs).otherwise(rb + demand * rs)).otherwise(multiplier)
    recent_g = F.when(year == 2024, 100.0).when(year == 2025, 100.0 * (1.0 + rate * 0.9)).otherwise(100.0 * (1.0 + rate * 1.8))
    g_hist = F.round(F.when(year < 2024, multiplier * 100.0).otherwise(recent_g), 1)
    i_hist = F.round(F.when(year < 2024, multiplier * 96.0).otherwise(100.0 * (1.0 + (year - 2024) * home_rate * 0.95)), 1)
    ahead = year - 2026
    base_g = F.greatest(F.lit(10.0), F.round(100.0 * (1.0 + rate * 1.8), 1))
    base_i = F.greatest(F.lit(10.0), F.round(100.0 * (1.0 + 2 * home_rate * 0.95), 1))
    g_next, i_next = damped_index(base_g, rate, ahead), damped_index(base_i, home_rate, ahead)
    spread = (1.0 - F.col("confidence_score")) * 14.0 * F.sqrt(F.greatest(ahead, F.lit(0)).cast("double"))
    hist = F.struct(
        F.lit("historical").alias("status"), F.greatest(F.lit(10.0), i_hist).alias("india_index"), F.greatest(F.lit(10.0), g_hist).alias("global_index"),
        F.greatest(F.lit(8.0), i_hist * 0.96).alias("india_lower_bound"), (i_hist * 1.04).alias("india_upper_bound"),
        F.greatest(F.lit(8.0), g_hist * 0.97).alias("global_lower_bound"), (g_hist * 1.03).alias("global_upper_bound"))
    fore = F.struct(
        F.lit("forecast").alias("status"), F.round(i_next, 1).alias("india_index"), F.round(g_next, 1).alias("global_index"),
        F.greatest(F.lit(10.0), F.round(i_next - spread * 1.1, 1)).alias("india_lower_bound"), F.round(i_next + spread * 1.1, 1).alias("india_upper_bound"),
        F.greatest(F.lit(10.0), F.round(g_next - spread, 1)).alias("global_lower_bound"), F.round(g_next + spread, 1).alias("global_upper_bound"))
    years = df.withColumn("year", F.explode(F.sequence(F.lit(2021), F.lit(2031))))
    return years.select("soc_code", "title", "year", F.when(year <= 2026, hist).otherwise(fore).alias("_p")).select("soc_code", "title", "year", "_p.*")


# --- ranking ------------------------------------------------------------------------------------

def normalized_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Known, non-negative weights with defaults filled in, scaled to 1."""
    if not weights:
        return dict(DEFAULT_WEIGHTS)
    merged = {k: max(0.0, float(weights.get(k, d))) for k, d in DEFAULT_WEIGHTS.items()}
    total = sum(merged.values())
    return {k: round(v / total, 4) for k, v in merged.items()} if total > 0 else dict(DEFAULT_WEIGHTS)


def composite_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = normalized_weights(weights)
    resilience = F.greatest(F.lit(0.0), 1.0 - F.col("ai_exposure_score") * 0.70)
    d = F.col("current_demand_score")
    score = (d * w["current_demand"] + F.col("growth_score") * w["growth"] + resilience * w["ai_resilience"]
             + d * 0.9 * w["salary_level"] + F.col("confidence_score") * w["confidence"])
    return df.withColumn("composite_score", F.round(score, 3))


def rank_careers(df: DataFrame, by: list[str], *, weights: dict[str, float] | None = None) -> DataFrame:
    """Careers of each request ranked by composite score."""
    return dense_rank_positions(composite_score(df, weights), by, "composite_score", ["title"])


# --- evidence and graph -------------------------------------------------------------------------

def evidence(df: DataFrame) -> DataFrame:
    """Adds ``drivers``: the sentences that explain an outlook (O09). Needs ``top_skills`` as an array.

    The wording of the sentences is fixed: it is part of the result.
    """
    total, velocity = F.col("total_postings"), F.col("velocity_ratio")
    auto, aug = F.col("automated"), F.col("augmented")
    home, world = F.size("i_places") > 0, F.size("g_places") > 0
    lead = F.trim(F.split_part(F.coalesce(F.get("i_places", F.lit(0)), F.lit("")), F.lit("("), F.lit(1)))
    volume = (F.when(total > 500, F.concat(F.lit("Substantial real-world market presence with "), F.format_number(total, 0),
                                           F.lit(" verified postings across global and Indian labor markets.")))
              .when(total > 50, F.concat(F.lit("Active recruitment signals with "), F.format_number(total, 0), F.lit(" job postings tracked.")))
              .otherwise("Emerging specialization with concentrated niche employer demand."))
    pace = (F.when(velocity > 0.6, "Strong recent hiring momentum with steady acceleration from 2024 through 2026.")
            .when(velocity > 0.3, "Consistent baseline posting velocity across consecutive hiring cycles."))
    impact = (F.when(aug > auto, F.format_string(
        "High augmentation leverage: %d tasks enhanced by generative AI tools, increasing worker productivity rather than substituting roles.", aug))
        .when(auto > 0, F.format_string(
            "Routine task automation: %d tasks exposed to workflow automation, shifting value toward strategic oversight.", auto))
        .otherwise(F.format_string("Task profile (%d O*NET tasks) indicates resilient cognitive and domain-specific problem solving.", F.col("task_count"))))
    breadth = (F.when(home & world, F.concat(F.lit("Balanced multi-regional hiring spanning leading Indian tech hubs ("), lead,
                                             F.lit(") and international markets.")))
               .when(home, F.concat(F.lit("Strong domestic Indian market concentration, primarily across "), lead,
                                    F.lit(" and surrounding tech centers."))))
    skills = F.when(F.size("top_skills") > 0, F.concat(
        F.lit("High employer demand for foundational and emerging capabilities: "),
        F.array_join(F.slice("top_skills", 1, 4), ", "), F.lit(".")))
    return df.withColumn("drivers", F.filter(F.array(volume, pace, impact, breadth, skills), lambda s: s.isNotNull()))


def _node_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def knowledge_graph(occupations: DataFrame, tasks: DataFrame, skills: DataFrame, technologies: DataFrame,
                    market_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every occupation's graph.

    ``occupations``: soc_code, title, domain. ``tasks``: scored tasks with ``position`` (5 used). ``skills`` and
    ``technologies``: name, importance or hot flag, ``position`` (6 used). ``market_skills`` (5 used) stand in
    where an occupation has no technology. Nodes are unique per (soc_code, id).
    """
    root = F.concat(F.lit("occ_"), "soc_code")
    domain = F.coalesce("domain", F.lit("Technology & Applied Sciences"))
    task_rows = tasks.where("position <= 5").select(
        "soc_code", F.concat(F.lit("task_"), "position").alias("id"),
        F.when(F.length("task_description") > 45, F.concat(F.substring("task_description", 1, 45), F.lit("..."))).otherwise(F.col("task_description")).alias("label"),
        F.lit("task").alias("type"), F.col("ai_impact_score").alias("weight"), F.lit("EXECUTES_TASK").alias("relationship"), F.col("ai_impact_score").alias("edge_weight"))
    importance = F.round(F.when(F.coalesce("importance", F.lit(0.0)) != 0, F.col("importance") / 100.0).otherwise(0.70), 2)
    skill_rows = skills.where("position <= 6").select(
        "soc_code", _node_id("skill_", F.col("skill_name")).alias("id"), F.col("skill_name").alias("label"), F.lit("skill").alias("type"),
        importance.alias("weight"), F.lit("REQUIRES_COMPETENCY").alias("relationship"), importance.alias("edge_weight"))
    stand_in = market_skills.where("position <= 5").join(technologies.select("soc_code").distinct(), "soc_code", "left_anti") \
        .select("soc_code", F.col("skill_normalized").alias("technology_name"), F.lit(1).alias("hot_technology"))
    tools = technologies.where("position <= 6").select("soc_code", "technology_name", "hot_technology").unionByName(stand_in)
    hot = F.col("hot_technology") == 1
    tool_rows = tools.where("technology_name <> ''").select(
        "soc_code", _node_id("tech_", F.col("technology_name")).alias("id"), F.col("technology_name").alias("label"), F.lit("technology").alias("type"),
        F.when(hot, 1.0).otherwise(0.65).alias("weight"), F.lit("UTILIZES_TOOL").alias("relationship"), F.when(hot, 0.90).otherwise(0.65).alias("edge_weight"))
    domain_rows = occupations.select("soc_code", _node_id("dom_", domain).alias("id"), domain.alias("label"), F.lit("domain").alias("type"),
                                     F.lit(0.85).alias("weight"), F.lit("BELONGS_TO_DOMAIN").alias("relationship"), F.lit(1.0).alias("edge_weight"))
    known = occupations.select("soc_code")
    parts = reduce(DataFrame.unionByName, [domain_rows, task_rows, skill_rows, tool_rows]).join(known, "soc_code", "left_semi")
    roots = occupations.select("soc_code", root.alias("id"), F.col("title").alias("label"), F.lit("occupation").alias("type"), F.lit(1.0).alias("weight"))
    nodes = roots.unionByName(parts.groupBy("soc_code", "id").agg(
        F.min_by("label", "label").alias("label"), F.min("type").alias("type"), F.max("weight").alias("weight")))
    edges = parts.select("soc_code", root.alias("source"), F.col("id").alias("target"), "relationship", F.col("edge_weight").alias("weight"))
    return nodes, edges


# --- everything together ------------------------------------------------------------------------

def history_by_occupation(terms: DataFrame, volumes: DataFrame, places: DataFrame) -> DataFrame:
    """One row per occupation with g_ and i_ posting figures; zero where nothing was posted."""
    def side(region: str, prefix: str, columns: dict[str, str]) -> DataFrame:
        return volumes.where(F.col("region") == region).select("pattern", *[F.col(c).alias(f"{prefix}_{n}") for c, n in columns.items()])

    world = side("global", "g", {"total": "total", "unique_companies": "companies", "avg_salary_mid": "avg_salary",
                                 "postings_2024": "2024", "postings_2025_plus": "2025"})
    home = side("india", "i", {"total": "total", "unique_companies": "companies", "avg_salary_min": "avg_min_inr", "avg_salary_max": "avg_max_inr",
                               "historical_postings": "historical", "modern_postings": "modern"})
    named = places.groupBy("pattern").agg(F.max_by("top_places", F.when(F.col("region") == "global", 1)).alias("_x"),
                                          F.any_value(F.when(F.col("region") == "global", F.col("top_places")), True).alias("g_places"),
                                          F.any_value(F.when(F.col("region") == "india", F.col("top_places")), True).alias("i_places")).drop("_x")
    out = terms.select("soc_code", "title", "pattern").join(world, "pattern", "left").join(home, "pattern", "left").join(named, "pattern", "left")
    zero = [c for c in out.columns if c.split("_")[-1] in ("total", "companies", "2024", "2025", "historical", "modern")]
    filled = out.fillna(0, zero)
    empty = F.array().cast("array<string>")
    return filled.withColumn("g_places", F.coalesce("g_places", empty)).withColumn("i_places", F.coalesce("i_places", empty))


def regional_breakdown(df: DataFrame) -> DataFrame:
    """Two rows per occupation: volume, growth proxy and pay by region."""
    pay = F.coalesce("i_avg_max_inr", "i_avg_min_inr")

    def side(region: str, volume: str, proxy: float, lpa: Column, usd: Column, places: str) -> Column:
        return F.struct(F.lit(region).alias("region"), F.col(volume).alias("posting_volume"),
                        F.round(F.col("velocity_ratio") * proxy, 1).alias("growth_proxy"), lpa.alias("median_salary_inr_lpa"),
                        usd.alias("median_salary_usd"), F.col(places).alias("top_places"))

    none = F.lit(None).cast("double")
    sides = F.array(side("india", "i_total", 15.0, F.round(pay / 100000.0, 1), F.round(pay * 0.012, 2), "i_places"),
                    side("global", "g_total", 18.0, none, F.round("g_avg_salary", 2), "g_places"))
    return df.select("soc_code", "title", F.explode(sides).alias("_r")).select("soc_code", "title", "_r.*")


def career_analysis(history: DataFrame, exposure: DataFrame, skills: DataFrame, *, region: str = "all") -> DataFrame:
    """The full analysis, one row per occupation.

    ``exposure`` from ``occupation_exposure``; ``skills`` is (title, top_skills array).
    """
    joined = demand_scores(history, region=region).join(exposure.drop("title"), "soc_code").join(skills, "title", "left")
    filled = joined.withColumn("top_skills", F.coalesce("top_skills", F.array().cast("array<string>")))
    return evidence(growth(filled))
