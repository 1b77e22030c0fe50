"""Readers of occupation and posting files. Each ``scan_*`` reads a path; each ``shape_*`` works on raw columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import year_month
from ..functions.numbers import inr_salary, inr_to_usd, parse_number, positive_number, years_range
from ..functions.places import city_part, guess_country
from ..functions.titles import normalize_title
from ..operators.ranks import keep_one

CODE = "O*NET-SOC Code"


def read_delimited(spark: SparkSession, path: str, columns: list[str], *, multi_line: bool = False) -> DataFrame:
    """Header CSV, or TSV for ``.txt``, every column as text. ``multi_line`` allows line breaks in quoted fields, at the
    price of one task for each file, however large."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, sep="\t" if path.endswith(".txt") else ",", quote='"', escape='"', multiLine=multi_line,
                          enforceSchema=False)


def trimmed(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def pick(df: DataFrame, *names: str) -> Column:
    """The first of several alternative columns that the file has; empty text where it has none."""
    present = [n for n in names if n in df.columns]
    return F.trim(F.coalesce(F.col(f"`{present[0]}`"), F.lit(""))) if present else F.lit("")


# --- occupation files -----------------------------------------------------------------------------

def shape_occupations(raw: DataFrame, *, order: str) -> DataFrame:
    """Codes with a title, the first row of a code."""
    rows = raw.select(trimmed(raw, CODE).alias("soc_code"), trimmed(raw, "Title").alias("title"), trimmed(raw, "Description").alias("description"), order)
    return keep_one(rows.where("soc_code <> '' AND title <> ''"), ["soc_code"], [F.asc(order)]).drop(order)


def scan_occupations(spark: SparkSession, path: str) -> DataFrame:
    raw = read_delimited(spark, path, [CODE, "Title", "Description"])
    return shape_occupations(raw.withColumn("_order", F.struct(F.input_file_name(), F.monotonically_increasing_id())), order="_order")


def shape_tasks(raw: DataFrame) -> DataFrame:
    """Task statements."""
    return raw.select(trimmed(raw, CODE).alias("soc_code"), trimmed(raw, "Task ID").alias("task_id"), trimmed(raw, "Task").alias("task_description"),
                      trimmed(raw, "Task Type").alias("task_type")).where("soc_code <> '' AND task_description <> ''")


def shape_skill_ratings(raw: DataFrame) -> DataFrame:
    """Skill ratings of the importance and level scales, malformed values as 0."""
    rows = raw.where(F.coalesce(F.trim("`Scale ID`"), F.lit("")).isin("IM", "LV", ""))
    return rows.select(trimmed(raw, CODE).alias("soc_code"), trimmed(raw, "Element Name").alias("skill_name"), parse_number(F.col("`Data Value`")).alias("importance")) \
        .where("soc_code <> '' AND skill_name <> ''")


def yes(df: DataFrame, name: str) -> Column:
    return (F.upper(trimmed(df, name)) == "Y").cast("int")


def shape_technologies(raw: DataFrame) -> DataFrame:
    """Technologies with their flags; the example is the first filled of several columns."""
    names = [n for n in ("Workplace Example", "Example", "Commodity Title", "Element Name") if n in raw.columns]
    example = F.coalesce(*[F.nullif(trimmed(raw, n), F.lit("")) for n in names])
    return raw.select(trimmed(raw, CODE).alias("soc_code"), example.alias("technology_name"), yes(raw, "Hot Technology").alias("hot_technology"),
                      yes(raw, "In Demand").alias("in_demand")).where("soc_code <> '' AND technology_name IS NOT NULL")


def shape_titles(raw: DataFrame) -> DataFrame:
    """Alternate titles with their match key."""
    from ..functions.titles import title_match_key

    title = pick(raw, "Job Title", "Reported Job Title")
    return raw.select(trimmed(raw, CODE).alias("soc_code"), title.alias("title"), title_match_key(title).alias("title_normalized"),
                      pick(raw, "Short Title").alias("short_title")).where("soc_code <> '' AND title <> ''")


# --- posting files --------------------------------------------------------------------------------

def shape_network_postings(raw: DataFrame, *, source: str) -> DataFrame:
    """Global postings with alternative column names."""
    lo, hi = positive_number(pick(raw, "min_salary", "salary_min")), positive_number(pick(raw, "max_salary", "salary_max"))
    ym = year_month(pick(raw, "listed_time", "list_date", "posted_date"))
    title, location = pick(raw, "title", "job_title"), pick(raw, "location", "job_location")
    return raw.select(
        F.lit(source).alias("source"), pick(raw, "job_id").alias("job_id"), title.alias("title"), normalize_title(title).alias("title_normalized"),
        pick(raw, "company_name", "company").alias("company"), location.alias("location"), guess_country(location).alias("country"),
        lo.alias("salary_min_usd"), hi.alias("salary_max_usd"), F.coalesce(positive_number(pick(raw, "med_salary", "salary_median")), (lo + hi) / 2.0).alias("salary_median_usd"),
        pick(raw, "skills_desc", "skills", "job_skills").alias("skills"), F.coalesce(ym["year"], F.lit(2024)).alias("listed_year"), ym["month"].alias("listed_month"),
        F.lit("global").alias("region")).where("title <> ''")


def shape_board_postings(raw: DataFrame, *, source: str, names: dict[str, str], default_year: int = 2024, fixed: tuple[int, int] | None = None) -> DataFrame:
    """Domestic postings: rupee text, experience text, city before the comma.

    ``names`` maps title, company, location, salary, experience, skills, date and id to the file's columns.
    """
    def col(key: str) -> Column:
        return pick(raw, names[key]) if key in names else F.lit("")

    pay, years, ym = inr_salary(col("salary")), years_range(col("experience")), year_month(col("date"))
    year, month = (F.lit(fixed[0]), F.lit(fixed[1])) if fixed else (F.coalesce(ym["year"], F.lit(default_year)), ym["month"])
    city = city_part(F.split_part(col("location"), F.lit("/"), F.lit(1)))
    return raw.select(
        F.lit(source).alias("source"), col("id").alias("job_id"), col("title").alias("title"), normalize_title(col("title")).alias("title_normalized"), col("company").alias("company"),
        col("location").alias("location"), city.alias("city"), pay["min"].alias("salary_min_inr"), pay["max"].alias("salary_max_inr"), inr_to_usd(pay["min"]).alias("salary_min_usd"),
        inr_to_usd(pay["max"]).alias("salary_max_usd"), years["min"].alias("experience_min"), years["max"].alias("experience_max"), col("skills").alias("skills"),
        year.alias("listed_year"), month.alias("listed_month"), F.lit("india").alias("region")).where("title <> ''")


def scan_board_json(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Domestic postings from JSON lines; malformed lines are dropped."""
    schema = "title string, companyName string, location string, salary string, experience string, tagsAndSkills string, jobId string"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("title IS NOT NULL")
    names = {"title": "title", "company": "companyName", "location": "location", "salary": "salary", "experience": "experience", "skills": "tagsAndSkills", "id": "jobId"}
    return shape_board_postings(raw, source="boards_json", names=names, fixed=(2024, 6), **kwargs)


def shape_tech_postings(raw: DataFrame) -> DataFrame:
    """Domestic technology postings paid in lakhs."""
    inr = positive_number(pick(raw, "Salary_LPA")) * 100000
    years, ym, city = years_range(pick(raw, "Experience_Level")), year_month(pick(raw, "Date_Posted")), pick(raw, "City")
    return raw.select(pick(raw, "Job_ID").alias("job_id"), pick(raw, "Job_Title").alias("title"), pick(raw, "Company").alias("company"), city.alias("city"),
                      F.when(city == "", "India").otherwise(F.concat(city, F.lit(", India"))).alias("location"), inr.alias("salary_min_inr"), inr.alias("salary_max_inr"),
                      inr_to_usd(inr).alias("salary_min_usd"), years["min"].alias("experience_min"), F.coalesce(ym["year"], F.lit(2025)).alias("listed_year")).where("title <> ''")


def salary_file(raw: DataFrame, *, source: str) -> tuple[DataFrame, DataFrame]:
    """(benchmarks, postings) of one salary file."""
    title, place, ym = pick(raw, "job_title"), pick(raw, "company_location"), year_month(pick(raw, "posting_date"))
    rows = raw.select(
        F.lit(source).alias("source"), pick(raw, "job_id").alias("job_id"), title.alias("title"), normalize_title(title).alias("title_normalized"), pick(raw, "company_name").alias("company"),
        F.when(F.lower(place).contains("india"), "india").otherwise("global").alias("region"), place.alias("country"), positive_number(pick(raw, "salary_usd")).alias("salary_usd"),
        pick(raw, "experience_level").alias("experience_level"), F.coalesce(ym["year"], F.lit(2025)).alias("year")).where("title <> ''")
    benchmarks = rows.select("source", "title", "title_normalized", "region", "country", "salary_usd", "experience_level", "year")
    postings = rows.select("source", "job_id", "title", "title_normalized", "company", "country", "region", F.col("salary_usd").alias("salary_min_usd"),
                           F.col("salary_usd").alias("salary_max_usd"), F.col("year").alias("listed_year"))
    return benchmarks, postings
