"""Occupation reference tables: ratings, tools, education, and the unified requirements of an occupation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import importance_norm, level_norm
from ..functions.places import contains_any
from ..functions.titles import canonical_code, item_slug, major_group
from .ranks import keep_one, top_k


def noise_dictionary(sources: list[tuple[DataFrame, str, str | None, int]]) -> DataFrame:
    """Terms that are never skills, from several sources; later sources decide the category.

    Each source is (rows, column, category or None to read a ``category`` column, shortest length left out).
    Spaces are also written as underscores.
    """
    def terms(i: int, df: DataFrame, column: str, category: str | None, longer_than: int) -> DataFrame:
        t = F.lower(F.trim(column))
        cat = F.col("category") if category is None else F.lit(category)
        return df.where(F.length(F.trim(column)) > longer_than).select(
            F.explode(F.array(t, F.replace(t, F.lit(" "), F.lit("_")))).alias("term"), cat.alias("category"), F.lit(i).alias("_order"))

    rows = reduce(DataFrame.unionByName, [terms(i, *s) for i, s in enumerate(sources)])
    return rows.where("term <> ''").groupBy("term").agg(F.max_by("category", "_order").alias("category"))


# --- ratings and other reference scans ------------------------------------------------------------

def element_ratings(rows: DataFrame, *, order: str = "load_id") -> DataFrame:
    """Long scale rows (IM, LV) to one row per code and element, last row of a scale wins.

    Flags are sticky: one Y anywhere marks the element.
    """
    def scale(name: str) -> Column:
        return F.max_by(F.when(F.col("scale_id") == name, F.col("data_value")), F.when(F.col("scale_id") == name, F.col(order)))

    keyed = rows.where((F.coalesce("soc_code", F.lit("")) != "") & (F.coalesce("element_id", F.lit("")) != ""))
    wide = keyed.groupBy("soc_code", "element_id").agg(
        F.max_by("element_name", order).alias("element_name"), F.coalesce(scale("IM"), F.lit(1.0)).alias("importance"),
        F.coalesce(scale("LV"), F.lit(0.0)).alias("level"), F.max_by("n", order).alias("n"),
        F.when(F.max(F.col("suppress") == "Y"), "Y").otherwise("N").alias("recommend_suppress"),
        F.when(F.max(F.col("not_relevant") == "Y"), "Y").otherwise("N").alias("not_relevant"))
    return wide.withColumn("importance_norm", importance_norm(F.col("importance"))).withColumn("level_norm", level_norm(F.col("level")))


def task_ratings(rows: DataFrame, *, order: str = "load_id") -> DataFrame:
    """Importance, relevance and expected frequency category of each task."""
    s, v = F.col("scale_id"), F.col("data_value")

    def last(name: str) -> Column:
        return F.max_by(F.when(s == name, v), F.when(s == name, F.col(order)))

    return rows.groupBy("soc_code", "task_id").agg(
        F.max_by("task_description", order).alias("task_description"), last("IM").alias("importance"), last("RT").alias("relevance"),
        F.sum(F.when(s == "FT", F.coalesce("category", F.lit(1.0)) * v / 100.0)).alias("frequency"))


def work_activities(rows: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Detailed activities with their intermediate activity, exact repeats removed."""
    lookup = keep_one(hierarchy, ["dwa_id"], [F.desc("load_id")]).select("dwa_id", "iwa_id", "iwa_title")
    return rows.join(lookup, "dwa_id", "left").distinct()


def roll_up_tools(tools: DataFrame, occupations: DataFrame) -> DataFrame:
    """Tools plus those inherited by parent codes that exist and list none themselves."""
    parent = F.concat(F.substring("soc_code", 1, 7), F.lit(".00"))
    child = tools.where(~F.col("soc_code").endswith(".00")).withColumn("soc_code", parent)
    inherited = child.join(occupations.select("soc_code"), "soc_code", "left_semi").join(tools.select("soc_code").distinct(), "soc_code", "left_anti")
    first = inherited.groupBy("soc_code", "example").agg(F.min(F.struct("commodity_code", "commodity_title")).alias("_c")) \
        .select("soc_code", "example", "_c.*")
    return tools.select("soc_code", "example", "commodity_code", "commodity_title").unionByName(first)


def education_levels(rows: DataFrame, categories: DataFrame, local_map: DataFrame) -> DataFrame:
    """Education shares with their category text and local equivalent."""
    described = rows.join(categories.select("element_id", "category", "category_description"), ["element_id", "category"], "left")
    return described.join(local_map.select("category", "local_level", "hierarchy_level"), "category", "left") \
        .withColumn("category_description", F.coalesce("category_description", F.lit("")))


def with_zone_text(zones: DataFrame, reference: DataFrame) -> DataFrame:
    """Job zones with their reference text."""
    return zones.join(reference, "job_zone", "left")


# --- unified requirements -------------------------------------------------------------------------

# Codes and phrases of tasks reserved by local regulation, and phrases of foreign rules.
RESERVED_CODES = ["29-1141.00", "31-9092.00"]
RESERVED_PHRASES = ["prescribe", "recommend drug"]
FOREIGN_PHRASES = ["401(k)", "irs form"]
RESERVED_REASON = ("Prescription of scheduled medications is legally reserved for registered medical practitioners (MBBS/MD) "
                   "under Indian medical regulations")
FOREIGN_REASON = "US-specific regulatory or tax compliance requirement"
ITEM_COLUMNS = ["soc_code", "item_type", "item_id", "item_name", "item_description", "importance_norm", "level_norm", "hot_technology",
                "in_demand", "india_demand_share", "source", "reliable", "posting_count", "soc_posting_total", "india_irrelevant_reason"]


def irrelevance_reason(code: Column, text: Column, *, foreign: bool, reserved_codes: list[str] = RESERVED_CODES) -> Column:
    """Why a task does not apply locally; NULL when it does."""
    low = F.lower(text)
    reason = F.when(code.isin(reserved_codes) & contains_any(low, RESERVED_PHRASES), RESERVED_REASON)
    return reason.when(contains_any(low, FOREIGN_PHRASES), FOREIGN_REASON) if foreign else reason


def _items(df: DataFrame, item_type: str, item_id: Column, name: Column, **extra: Column) -> DataFrame:
    """Requirement rows of one kind; columns not given take the kind's neutral value."""
    neutral = {"item_description": name, "importance_norm": F.lit(None).cast("double"), "level_norm": F.lit(None).cast("double"),
               "hot_technology": F.lit(0), "in_demand": F.lit(0), "india_demand_share": F.lit(None).cast("double"),
               "source": F.lit("onet"), "reliable": F.lit(1), "posting_count": F.lit(0).cast("long"),
               "soc_posting_total": F.lit(None).cast("long"), "india_irrelevant_reason": F.lit(None).cast("string")}
    values = {**neutral, **extra}
    return df.select("soc_code", F.lit(item_type).alias("item_type"), item_id.alias("item_id"), name.alias("item_name"),
                     *[values[c].alias(c) for c in ITEM_COLUMNS[4:]])


def rating_items(item_type: str, ratings: DataFrame, content_model: DataFrame, *, flagged: bool = True) -> DataFrame:
    """Skills, knowledge, abilities or activities as requirement rows."""
    joined = ratings.join(content_model.select("element_id", "description"), "element_id", "left")
    doubtful = (F.col("recommend_suppress") == "Y") | (F.col("not_relevant") == "Y")
    return _items(joined, item_type, F.col("element_id"), F.col("element_name"), importance_norm=F.col("importance_norm"),
                  level_norm=F.col("level_norm"), item_description=F.coalesce("description", "element_name"),
                  reliable=F.when(doubtful, 0).otherwise(1) if flagged else F.lit(1))


def task_items(tasks: DataFrame, *, reserved_codes: list[str] = RESERVED_CODES) -> DataFrame:
    text = F.col("task_description")
    return _items(tasks, "task", F.col("task_id"), text, importance_norm=importance_norm(F.coalesce("importance", F.lit(3.0))),
                  india_irrelevant_reason=irrelevance_reason(F.col("soc_code"), text, foreign=True, reserved_codes=reserved_codes))


def activity_items(activities: DataFrame) -> DataFrame:
    text = F.col("dwa_title")
    return _items(activities, "dwa", F.col("dwa_id"), text, importance_norm=F.lit(0.70),
                  india_irrelevant_reason=irrelevance_reason(F.col("soc_code"), text, foreign=False))


def technology_items(technologies: DataFrame) -> DataFrame:
    name, hot = F.col("example"), F.col("hot_technology")
    return _items(technologies, "tech", item_slug("tech", name), name, item_description=F.coalesce("commodity_title", "example"),
                  importance_norm=F.when(hot == 1, 0.85).otherwise(0.50), hot_technology=hot, in_demand=F.col("in_demand"))


def tool_items(tools: DataFrame) -> DataFrame:
    name = F.col("example")
    return _items(tools, "tool", item_slug("tool", name), name, item_description=F.coalesce("commodity_title", "example"), importance_norm=F.lit(0.65))


def market_items(demand: DataFrame) -> DataFrame:
    """Market skills of ``demand`` (soc_code, region, skill_normalized, skill_name, posting_count, ... , importance_norm)."""
    curated = F.col("source") == "curated"
    rows = demand.where(F.col("region").isin("india", "curated"))
    return _items(rows, "market_skill", F.col("skill_normalized"), F.col("skill_name"),
                  item_description=F.when(curated, "Curated domain competency").otherwise("Extracted from Indian job postings"),
                  importance_norm=F.when(curated, 0.50).otherwise(F.col("importance_norm")), in_demand=F.lit(1),
                  india_demand_share=F.when(~curated, F.col("share_of_postings")), source=F.col("source"),
                  posting_count=F.col("posting_count"), soc_posting_total=F.col("soc_posting_total"))


def unified_requirements(parts: list[DataFrame]) -> DataFrame:
    """All requirement kinds in one table, one row per (code, type, name)."""
    rows = reduce(DataFrame.unionByName, parts)
    out = rows.groupBy("soc_code", "item_type", "item_name").agg(
        F.min("item_id").alias("item_id"), F.max("item_description").alias("item_description"),
        *[F.max(c).alias(c) for c in ("importance_norm", "level_norm", "hot_technology", "in_demand", "india_demand_share")],
        F.min("source").alias("source"), *[F.max(c).alias(c) for c in ("reliable", "posting_count", "soc_posting_total")],
        F.min(F.col("india_irrelevant_reason").isNull().cast("int")).alias("india_relevant"),
        F.max("india_irrelevant_reason").alias("india_irrelevant_reason"))
    return out.select(*ITEM_COLUMNS[:-1], "india_relevant", "india_irrelevant_reason")


def requirements_of(requirements: DataFrame, codes: list[str], *, item_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Requirements of some codes, most important first, NULL importance last."""
    wanted = requirements.sparkSession.createDataFrame([(c,) for c in codes], "code string").select(canonical_code(F.col("code")).alias("soc_code")).distinct()
    rows = requirements.join(wanted, "soc_code", "left_semi")
    rows = rows if item_type is None else rows.where(F.col("item_type") == item_type)
    order = [F.desc(F.coalesce("importance_norm", F.lit(0.0))), F.asc("item_type"), F.asc("item_name")]
    return top_k(rows, ["soc_code"], order, limit) if limit else rows.orderBy("soc_code", *order)


def counts_by_type(requirements: DataFrame) -> DataFrame:
    """Requirement counts per code and kind as columns."""
    kinds = ["skill", "knowledge", "ability", "work_activity", "task", "dwa", "tech", "tool", "market_skill"]
    t = F.col("item_type")
    return requirements.groupBy("soc_code").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(t == k).alias(k) for k in kinds])


def related_occupations(related: DataFrame, domains: DataFrame, zones: DataFrame, *, k: int = 20) -> DataFrame:
    """Related occupations with domain and zone, best tier then index first."""
    top = top_k(related, ["soc_code"], [F.asc_nulls_first("relatedness_tier"), F.asc_nulls_first("index_val"), F.asc("related_soc_code")], k)
    d = domains.select(F.col("soc_code").alias("related_soc_code"), "major_group_title", "career_cluster")
    z = zones.select(F.col("soc_code").alias("related_soc_code"), "job_zone")
    return top.join(d, "related_soc_code", "left").join(z, "related_soc_code", "left")


def occupation_profiles(occupations: DataFrame, *, zones: DataFrame, education: DataFrame, experience: DataFrame, salaries: DataFrame,
                        related: DataFrame) -> DataFrame:
    """One nested row per occupation: domain, zone, education, experience, salary bands, related ones.

    Each nested list is bounded by its own table: education categories, band cells, at most ten related rows.
    """
    def nested(df: DataFrame, name: str, order: list[Column], columns: list[str]) -> DataFrame:
        row = F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])
        listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(*[x[f"_{c}"].alias(c) for c in columns]))
        return df.groupBy("soc_code").agg(listed.alias(name))

    edu = nested(education, "education", [(-F.col("percent")).alias("a"), F.col("category").alias("b")], ["category", "local_level", "percent"])
    pay = nested(salaries, "salary_percentiles", [(-F.col("sample_size")).alias("a"), F.col("city_canonical").alias("b"), F.col("experience_bucket").alias("c"), F.col("work_mode").alias("d")],
                 ["city_canonical", "experience_bucket", "work_mode", "p25", "p50", "p75", "sample_size"])
    near = top_k(related, ["soc_code"], [F.asc_nulls_first("relatedness_tier"), F.asc_nulls_first("index_val"), F.asc("related_soc_code")], 10)
    near = nested(near, "related", [F.col("position").alias("a")], ["related_soc_code", "relatedness_tier", "index_val"])
    base = occupations.select("soc_code", "title", major_group(F.col("soc_code")).alias("domain")).join(zones, "soc_code", "left") \
        .join(edu, "soc_code", "left").join(experience, "soc_code", "left").join(pay, "soc_code", "left").join(near, "soc_code", "left")
    first = F.get("education", F.lit(0))["local_level"]
    return base.withColumn("primary_qualification", F.when(F.col("education").isNotNull(), first)
                           .otherwise(F.coalesce("education_text", F.lit("Bachelor's Degree"))))
