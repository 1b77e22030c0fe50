from pyspark.sql import functions as F

from laborcast.functions import dates, numbers, places, posting_text, skill_text, titles


def one(spark, column, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column.alias("y")).first()["y"]


def test_titles(spark):
    x = F.col("x")
    assert one(spark, titles.normalize_title(x), "Sr. Data Engineer (Remote) II") == "data engineer"
    assert one(spark, titles.title_match_key(x), "Assistant Head Nurse [ICU]") == "nurse"
    assert one(spark, titles.canonical_code(x), "29-1141") == "29-1141.00"
    assert one(spark, titles.next_rung(x), "Data Analyst") == "Senior Data Analyst"
    assert one(spark, titles.next_rung(x), "Sr. Data Analyst") == "Lead Data Analyst"
    assert one(spark, titles.next_rung(x), "Principal Analyst") is None
    assert tuple(one(spark, titles.title_band(x), "Lead Engineer")) == (6.0, 12.0)
    assert one(spark, titles.item_slug("tech", x), "Power BI/Desktop (x)") == "tech_power_bi_desktop_x"


def test_numbers(spark):
    x = F.col("x")
    assert tuple(one(spark, numbers.inr_salary(x), "3-6 Lacs PA")) == (300000.0, 600000.0)
    assert tuple(one(spark, numbers.inr_salary(x), "1,50,000 - 2,25,000 P.A")) == (150000.0, 225000.0)
    assert tuple(one(spark, numbers.inr_salary(x), "Not disclosed")) == (None, None)
    assert tuple(one(spark, numbers.years_range(x), "2+ years")) == (2.0, None)
    assert tuple(one(spark, numbers.posting_years(x), "at least 4 years")) == (4.0, None)
    assert tuple(one(spark, numbers.posting_years(x), "3-5 years")) == (3.0, 5.0)
    assert tuple(one(spark, numbers.posting_years(x), "2 years of experience")) == (2.0, None)
    assert one(spark, numbers.positive_number(x), "$1,200") == 1200.0
    assert one(spark, numbers.plausible_salary(x), 10.0, "double") is None
    assert one(spark, numbers.lakhs(x), 1250000, "long") == "12.5"
    assert one(spark, numbers.round_to_step(x, 50_000), 1275000, "long") == 1300000


def test_dates_and_places(spark):
    x = F.col("x")
    assert tuple(one(spark, dates.year_month(x), "1704067200000")) == (2024, 1)
    assert tuple(one(spark, dates.year_month(x), "15/03/2023")) == (2023, 3)
    assert one(spark, dates.age_text(x), 0.4, "double") == "fetched 24 min ago"
    assert one(spark, dates.age_text(x), 10.0, "double") == "fetched 10 h ago"
    assert one(spark, places.normalize_city(x), "bangalore, karnataka") == "Bengaluru"
    assert one(spark, places.expand_city(x), "Delhi-NCR") == ["Delhi", "Noida", "Gurugram"]
    assert one(spark, places.guess_country(x), "Toronto, Canada") == "United States"  # ", ca" comes first
    assert one(spark, places.canonical_city(x), "- somewhere")["city_canonical"] == "Somewhere"
    assert one(spark, places.city_from_path(x), ["India", "Karnataka", "Bangalore"], "array<string>") == "Bengaluru"


def test_text(spark):
    x = F.col("x")
    assert one(spark, skill_text.split_skills(x), "['a', 'b']") == ["a", "b"]
    assert one(spark, skill_text.split_skills(x), "a | b ; c") == ["a", "b ; c"]
    assert one(spark, skill_text.skill_slug(x), "Node.js") == "nodejs"
    assert one(spark, skill_text.misread_key(x), "Power Bl") == one(spark, skill_text.misread_key(x), "Power BI")
    assert one(spark, posting_text.work_mode(x), "WFH possible") == "remote"
    same = [("Dev", "Acme Pvt. Ltd", "Pune"), ("dev!", "ACME Technologies", "pune")]
    keys = spark.createDataFrame(same, "t string, c string, l string").select(posting_text.duplicate_key(F.col("t"), F.col("c"), F.col("l")).alias("k")).distinct()
    assert keys.count() == 1
