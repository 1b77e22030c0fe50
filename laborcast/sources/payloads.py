"""Provider payloads held as JSON text columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers, places, posting_text
from ..functions.dates import posted_timestamp

LISTING = ("array<struct<id:string,title:string,description:string,company:struct<display_name:string>,location:struct<area:array<string>,display_name:string>,"
           "contract_time:string,contract_type:string,created:string,salary_min:double,salary_max:double,salary_is_predicted:string>>")
FULLTEXT = ("array<struct<job_id:string,job_title:string,employer_name:string,job_description:string,job_city:string,job_is_remote:boolean,job_employment_type:string,"
            "job_min_salary:double,job_max_salary:double,job_salary_period:string,job_salary_currency:string,job_salary_string:string,"
            "job_posted_at_datetime_utc:string,job_offer_expiration_datetime_utc:string>>")


def listings(payloads: DataFrame, payload: str) -> DataFrame:
    """Postings of ``{"results": [...]}`` payloads."""
    rows = payloads.select(F.explode(F.from_json(F.col(payload), f"results {LISTING}")["results"]).alias("r"))
    r, text = F.col("r"), F.concat_ws("\n", "r.title", F.coalesce("r.description", F.lit("")))
    years = numbers.posting_years(text)
    pay = numbers.ordered_pair(numbers.plausible_salary(r["salary_min"]), numbers.plausible_salary(r["salary_max"]))
    return rows.where(r["id"].isNotNull() & (F.trim(r["title"]) != "")).select(
        F.concat(F.lit("listings:"), r["id"]).alias("job_id"), F.trim(r["title"]).alias("title"), r["company"]["display_name"].alias("company"), r["description"].alias("description"),
        posting_text.description_quality(r["description"]).alias("description_quality"), places.city_from_path(r["location"]["area"]).alias("location"),
        posting_text.employment_type(r["title"], r["contract_time"], r["contract_type"]).alias("employment_type"), posting_text.work_mode(text).alias("work_mode"),
        years["min"].alias("experience_min"), years["max"].alias("experience_max"), pay["min"].alias("salary_min"), pay["max"].alias("salary_max"),
        (F.coalesce(r["salary_is_predicted"], F.lit("0")) == "1").alias("salary_is_predicted"), posted_timestamp(r["created"]).alias("posted_at"), F.lit("listings").alias("source"))


def fulltext(payloads: DataFrame, payload: str, *, now: Column) -> DataFrame:
    """Postings of ``{"data": {"jobs": [...]}}`` and older ``{"data": [...]}`` payloads, expired ones dropped."""
    col = F.col(payload)
    newer = F.from_json(F.get_json_object(col, "$.data.jobs"), FULLTEXT)
    older = F.from_json(F.get_json_object(col, "$.data"), FULLTEXT)
    rows = payloads.select(F.explode(F.coalesce(newer, older)).alias("r"))
    r, text = F.col("r"), F.concat_ws("\n", "r.job_title", F.coalesce("r.job_description", F.lit("")))
    expires = posted_timestamp(r["job_offer_expiration_datetime_utc"])
    rupees = posting_text.salary_currency(r["job_salary_currency"], r["job_salary_string"]) == "INR"

    def amount(name: str) -> Column:
        return F.when(rupees, numbers.yearly_amount(r[name], r["job_salary_period"]))

    pay, years = numbers.ordered_pair(amount("job_min_salary"), amount("job_max_salary")), numbers.posting_years(text)
    return rows.where(r["job_id"].isNotNull() & (F.trim(r["job_title"]) != "") & (expires.isNull() | (expires >= now.cast("timestamp")))).select(
        F.concat(F.lit("fulltext:"), r["job_id"]).alias("job_id"), F.trim(r["job_title"]).alias("title"), r["employer_name"].alias("company"), r["job_description"].alias("description"),
        places.normalize_city(r["job_city"]).alias("location"), posting_text.employment_from_codes(r["job_title"], F.array(F.coalesce(r["job_employment_type"], F.lit("")))).alias("employment_type"),
        posting_text.work_mode(text, r["job_is_remote"]).alias("work_mode"), years["min"].alias("experience_min"), pay["min"].alias("salary_min"), pay["max"].alias("salary_max"),
        posted_timestamp(r["job_posted_at_datetime_utc"]).alias("posted_at"), F.lit("fulltext").alias("source"))


def salary_histogram(payloads: DataFrame, by: list[str], payload: str) -> DataFrame:
    """(by, bound, vacancies) of ``{"histogram": {"0": 117, ...}}`` payloads."""
    bars = F.from_json(F.get_json_object(F.col(payload), "$.histogram"), "map<string,int>")
    return payloads.select(*by, F.explode(bars).alias("bound", "vacancies")) \
        .select(*by, F.col("bound").cast("double").cast("long").alias("bound"), "vacancies")


def salary_estimate(payloads: DataFrame, by: list[str], payload: str) -> DataFrame:
    """The first usable estimate of each payload: rupees, a known period, ordered figures."""
    item = "array<struct<min_salary:double,median_salary:double,max_salary:double,salary_period:string,salary_currency:string,salary_count:long,confidence:string>>"
    rows = payloads.select(*by, F.posexplode(F.from_json(F.get_json_object(F.col(payload), "$.data"), item)).alias("_i", "r"))
    r = F.col("r")
    lo, mid, hi = (numbers.yearly_amount(r[c], r["salary_period"]) for c in ("min_salary", "median_salary", "max_salary"))
    usable = rows.where((F.upper(r["salary_currency"]) == "INR") & F.upper(r["salary_period"]).isin(*numbers.PERIODS_PER_YEAR) & (lo <= mid) & (mid <= hi))
    first = usable.groupBy(*by).agg(F.min_by(F.struct(lo.alias("min"), mid.alias("median"), hi.alias("max"), r["salary_count"].alias("count"),
                                                      F.upper(r["confidence"]).alias("label")), "_i").alias("_e"))
    return first.select(*by, "_e.*")
