"""Postings of several sources merged into one list of current jobs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.posting_text import duplicate_key

MAX_AGE_DAYS, TTL_HOURS = 45, 6


def of_employment(jobs: DataFrame, wanted: list[str]) -> DataFrame:
    """Jobs of the wanted types; unknown types stay."""
    return jobs.where(F.col("employment_type").isin([*wanted, "unknown"])) if wanted else jobs


def unexpired(jobs: DataFrame, now: Column, *, days: int = MAX_AGE_DAYS) -> DataFrame:
    """Jobs posted within ``days`` of ``now``; undated jobs stay."""
    cutoff = now.cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return jobs.where(F.col("posted_at").isNull() | (F.col("posted_at").cast("timestamp") >= cutoff))


def merge_duplicates(jobs: DataFrame, *, source_order: list[str], donor_source: str, has_skills: Column | None = None) -> DataFrame:
    """One row per job seen at several sources: the best copy, with a fuller copy's description noted.

    A donor is a copy of ``donor_source`` that has skills to give, where ``has_skills`` tells (all have without it).
    Best: a real salary, any salary, the longer description, then source order. Each key is reduced with partial
    aggregates, so a key with very many copies is combined on the map side first.
    """
    keyed = jobs.withColumn("duplicate_key", duplicate_key(F.col("title"), F.col("company"), F.col("location_raw")))
    size = F.length(F.coalesce("description", F.lit("")))
    order = F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source"))
    quality = F.struct((F.col("salary_min").isNotNull() & ~F.col("salary_is_predicted")).alias("a"), F.col("salary_min").isNotNull().alias("b"), size.alias("c"),
                       (-order).alias("d"), (-F.col("job_id")).alias("e"))
    row = F.struct(*[F.col(c) for c in jobs.columns])
    donor = F.when((F.col("source") == donor_source) & (F.lit(True) if has_skills is None else F.coalesce(has_skills, F.lit(False))), F.struct(size.alias("n"), F.col("job_id").alias("job_id")))
    merged = keyed.groupBy("duplicate_key").agg(F.max_by(row, quality).alias("_best"), F.max(donor).alias("_donor"), F.count(F.lit(1)).alias("copies"))
    length = F.length(F.coalesce("_best.description", F.lit("")))
    use = (F.col("_best.source") != donor_source) & (F.col("_donor.n") > length)
    return merged.select("duplicate_key", "_best.*", "copies", F.when(use, F.col("_donor.job_id")).otherwise(F.col("_best.job_id")).alias("skills_from"))


def current_snapshots(rows: DataFrame, by: list[str], now: Column, *, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """Rows of the newest snapshot per market, flagged stale with their age past the TTL."""
    newest = rows.groupBy(*by).agg(F.max("fetched_at").alias("fetched_at"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 3.6e9
    return rows.join(newest, [*by, "fetched_at"], "left_semi").withColumn("age_hours", F.round(hours, 1)).withColumn("stale", hours > ttl_hours)


def audit(before: DataFrame, now: Column, wanted: list[str], *, source_order: list[str], donor_source: str) -> DataFrame:
    """Rows lost to expiry, to merging and to the type filter."""
    fresh = unexpired(before, now)
    merged = merge_duplicates(fresh, source_order=source_order, donor_source=donor_source)

    def n(df: DataFrame, step: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(step).alias("step"), "rows")

    return n(before, "fetched").unionByName(n(fresh, "fresh")).unionByName(n(merged, "merged")).unionByName(n(of_employment(fresh, wanted), "of_type"))


def market_age(rows: DataFrame, by: list[str], now: Column) -> DataFrame:
    """Oldest fetch and row totals per market."""
    from ..functions.dates import age_hours, age_text

    return rows.groupBy(*by).agg(F.min("fetched_at").alias("oldest"), F.sum("total_count").alias("total_available")) \
        .withColumn("age_hours", age_hours(F.col("oldest"), now)).withColumn("data_age", age_text(F.col("age_hours")))


def enrich_missing(jobs: DataFrame, enrich) -> DataFrame:
    """Runs ``enrich`` on the rows whose skills were never extracted and leaves the others alone."""
    done = F.coalesce(F.col("skills_source") == "extracted", F.lit(False))
    again = enrich(jobs.where(~done)).withColumn("skills_source", F.lit("extracted"))
    return jobs.where(done).unionByName(again, allowMissingColumns=True)
