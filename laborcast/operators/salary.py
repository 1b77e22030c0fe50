"""Salary intelligence: market estimates from several sources, candidate ranges and negotiation figures."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import lakhs_range, round_to_step
from .ranks import keep_one, linear_percentiles, weighted_percentiles

# Fixed values
MAX_RATIO, MIN_POSTED, MIN_HISTOGRAM, MIN_PERCENTILE, MIN_CITY, SMALL_SAMPLE = 4.0, 5, 20, 30, 50, 100
TOLERANCE, ESTIMATE_TTL_DAYS, SENIOR_CAP = 0.25, 7, 12.0
LABEL_CONFIDENCE = {"VERY_HIGH": 0.70, "HIGH": 0.60, "MEDIUM": 0.50, "LOW": 0.35}
TIER_BANDS = {"entry": (0.0, 3.0), "mid": (3.0, 5.0), "senior": (5.0, SENIOR_CAP)}
METRO_OF = {"Delhi": "Delhi NCR", "Noida": "Delhi NCR", "Gurugram": "Delhi NCR"}
# Years below -> bucket, and each bucket's band.
BUCKETS = [(1, "LESS_THAN_ONE"), (4, "ONE_TO_THREE"), (7, "FOUR_TO_SIX"), (10, "SEVEN_TO_NINE"), (15, "TEN_TO_FOURTEEN")]
BUCKET_BANDS = {"LESS_THAN_ONE": (0.0, 1.0), "ONE_TO_THREE": (1.0, 3.0), "FOUR_TO_SIX": (4.0, 6.0), "SEVEN_TO_NINE": (7.0, 9.0),
                "TEN_TO_FOURTEEN": (10.0, 14.0), "ABOVE_FIFTEEN": (15.0, 25.0)}
SOURCE_ORDER = ["posted_salaries", "market_percentiles", "external_estimate", "histogram", "baseline"]
POINTS = {"q1": 0.25, "med": 0.50, "q3": 0.75}
ESTIMATE = ["estimated_min", "estimated_median", "estimated_max", "confidence", "sample_size"]


def posted_points(jobs: DataFrame) -> DataFrame:
    """Adds why a posted salary is unusable (``excluded``) or its midpoint (``point``)."""
    lo, hi = F.col("salary_min"), F.col("salary_max")
    reason = (F.when(lo.isNull() & hi.isNull(), "no_salary").when(F.col("salary_is_predicted"), "predicted")
              .when((lo > 0) & (hi > 0) & (hi / F.nullif(lo, F.lit(0)) > MAX_RATIO), "wide_range"))
    mid = (F.coalesce(lo, hi) + F.coalesce(hi, lo)) / 2.0
    return jobs.select("*", reason.alias("excluded"), F.when(reason.isNull(), mid).alias("point"))


def outlier_fences(points: DataFrame, by: list[str]) -> DataFrame:
    """Tukey fences per group; groups under four points keep everything."""
    q = linear_percentiles(points, by, "point", {"q1": 0.25, "q3": 0.75})
    wide = (F.col("q3") - F.col("q1")) * 1.5
    fenced = F.col("n") >= 4
    return q.select(*by, F.when(fenced, F.col("q1") - wide).alias("low"), F.when(fenced, F.col("q3") + wide).alias("high"))


def trim_outliers(points: DataFrame, by: list[str]) -> DataFrame:
    """Points with ``kept`` telling whether they lie inside their group's fences."""
    rows = points.where(F.col("point").isNotNull()).join(outlier_fences(points, by), by)
    inside = F.col("low").isNull() | F.col("point").between(F.col("low"), F.col("high"))
    return rows.withColumn("kept", inside).drop("low", "high")


def exclusion_counts(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Rows left out per group and reason, outliers included."""
    graded = posted_points(jobs)
    reasons = graded.where("excluded IS NOT NULL").groupBy(*by, F.col("excluded").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    outliers = trim_outliers(graded, by).where("NOT kept").groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).withColumn("reason", F.lit("outlier"))
    return reasons.unionByName(outliers)


def _rounded(df: DataFrame, by: list[str], lo: Column, mid: Column, hi: Column, confidence: Column, n: Column, source: str, **extra: Column) -> DataFrame:
    return df.select(*by, F.lit(source).alias("source"), round_to_step(lo, 10_000).alias("estimated_min"), round_to_step(mid, 10_000).alias("estimated_median"),
                     round_to_step(hi, 10_000).alias("estimated_max"), F.round(confidence, 2).alias("confidence"), n.cast("long").alias("sample_size"),
                     *[c.alias(k) for k, c in extra.items()])


def posted_estimate(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of usable posted salaries, groups of five and more."""
    kept = trim_outliers(posted_points(jobs), by).where("kept")
    q = linear_percentiles(kept, by, "point", POINTS).where(F.col("n") >= MIN_POSTED)
    confidence = F.least(F.lit(0.85), 0.45 + 0.03 * F.col("n")) - F.when(F.col("q3") - F.col("q1") > F.col("med"), 0.1).otherwise(0.0)
    return _rounded(q, by, F.col("q1"), F.col("med"), F.col("q3"), confidence, F.col("n"), "posted_salaries")


def histogram_points(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by, point, weight): bucket midpoints; the last bucket is as wide as the one before."""
    w = W.partitionBy(*by).orderBy("bound")
    bound = F.col("bound")
    width = F.coalesce(F.lead("bound").over(w) - bound, bound - F.lag("bound").over(w), F.nullif(bound, F.lit(0)), F.lit(100_000))
    return histogram.select(*by, (bound + width / 2).alias("point"), F.col("vacancies").alias("weight")).where("weight > 0")


def histogram_estimate(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Weighted quartiles of a salary histogram with at least twenty vacancies."""
    q = weighted_percentiles(histogram_points(histogram, by), by, "point", "weight", POINTS).where(F.col("n") >= MIN_HISTOGRAM)
    return _rounded(q, by, F.col("q1"), F.col("med"), F.col("q3"), F.lit(0.5), F.col("n"), "histogram")


def experience_tier(years: Column) -> Column:
    return F.when(years < 3, "entry").when(years <= 5, "mid").otherwise("senior")


def percentile_salary(requests: DataFrame, bands: DataFrame, *, remote_only: bool = False) -> DataFrame:
    """Market percentiles resolved per request: remote band, experience tier x city ratio, tier, or overall.

    ``requests``: candidate_id, role, city, experience_years. ``bands``: role, band, p25, p50, p75, sample_size, with
    the band names of ``facts.salary_bands``. Figures are in rupees per year.
    """
    metro = F.col("city")
    for name, group in METRO_OF.items():
        metro = F.when(F.col("city") == name, group).otherwise(metro)
    asked = requests.withColumn("tier", experience_tier(F.col("experience_years"))).withColumn("_metro", metro)

    # A role has few bands, so they travel as one map and each request meets them once.
    figures = F.struct("p25", "p50", "p75", "sample_size")
    by_role = bands.groupBy("role").agg(F.map_from_entries(F.collect_list(F.struct("band", figures))).alias("_bands"))
    band = lambda label: F.try_element_at(F.col("_bands"), label)
    rows = asked.join(by_role, "role").select(
        *asked.columns, band(F.concat(F.lit("exp:"), "tier")).alias("_t"), band(F.lit("onsite")).alias("_o"),
        band(F.concat(F.lit("city:"), "_metro")).alias("_c"), band(F.lit("remote")).alias("_r"))
    use_remote = F.lit(remote_only) & (F.coalesce("_r.sample_size", F.lit(0)) >= MIN_PERCENTILE)
    use_tier = F.coalesce("_t.sample_size", F.lit(0)) >= MIN_PERCENTILE
    use_city = use_tier & (F.coalesce("_c.sample_size", F.lit(0)) >= MIN_CITY) & F.col("_o").isNotNull()
    base = F.when(use_remote, F.col("_r")).when(use_tier, F.col("_t")).otherwise(F.col("_o"))
    ratio = F.when(~use_remote & use_city, F.col("_c.p50") / F.col("_o.p50")).otherwise(1.0)
    method = F.when(use_remote, "remote").when(use_city, "experience_x_city_ratio").when(use_tier, "experience_bucket").otherwise("overall")
    return rows.where(base.isNotNull()).select(
        "candidate_id", "role", *[(base[p] * ratio * 100_000).alias(p) for p in ("p25", "p50", "p75")], base["sample_size"].alias("sample_size"),
        method.alias("method"), F.when(~use_remote & use_tier, F.col("tier")).alias("tier"))


def percentile_confidence(n: Column) -> Column:
    return F.least(F.lit(0.85), 0.55 + 0.05 * F.log10(n.cast("double"))) - F.when(n < SMALL_SAMPLE, 0.1).otherwise(0.0)


def label_confidence(label: Column) -> Column:
    return reduce(lambda acc, kv: F.when(label == kv[0], kv[1]).otherwise(acc), LABEL_CONFIDENCE.items(), F.lit(0.45))


def two_source_estimate(percentiles: DataFrame, estimates: DataFrame, by: list[str]) -> DataFrame:
    """Percentiles checked against an external estimate.

    Medians within a quarter agree and the percentiles stand; beyond it the larger sample stands with less confidence.
    ``estimates``: by, min, median, max, count, label.
    """
    rows = percentiles.where(F.col("sample_size") >= MIN_PERCENTILE).join(estimates, by, "left")
    gap = (F.col("median") - F.col("p50")) / F.col("p50")
    agree = F.abs(gap) <= TOLERANCE
    theirs = F.coalesce(~agree & (F.col("count") > F.col("sample_size")), F.lit(False))
    cost = F.when(F.coalesce(agree, F.lit(True)), 0.0).otherwise(0.1)
    confidence = F.when(theirs, label_confidence(F.col("label"))).otherwise(percentile_confidence(F.col("sample_size"))) - cost
    out = _rounded(rows, by, F.when(theirs, F.col("min")).otherwise(F.col("p25")), F.when(theirs, F.col("median")).otherwise(F.col("p50")),
                   F.when(theirs, F.col("max")).otherwise(F.col("p75")), confidence, F.when(theirs, F.col("count")).otherwise(F.col("sample_size")), "market_percentiles",
                   gap_pct=F.round(gap * 100, 1), agree=agree, primary=F.when(theirs, "external_estimate").otherwise("market_percentiles"))
    return out


def external_estimate(estimates: DataFrame, by: list[str]) -> DataFrame:
    return _rounded(estimates, by, F.col("min"), F.col("median"), F.col("max"), label_confidence(F.col("label")), F.col("count"), "external_estimate")


def baseline_estimate(baseline: DataFrame, by: list[str]) -> DataFrame:
    """A regional median in lakhs, give or take a quarter."""
    mid = F.col("median_lpa") * 100_000
    return _rounded(baseline.where("median_lpa > 0"), by, mid * 0.75, mid, mid * 1.25, F.lit(0.3), F.lit(0), "baseline")


def market_estimate(groups: DataFrame, sources: list[DataFrame], by: list[str]) -> DataFrame:
    """The first source in the fixed order that has an estimate for a group; none leaves NULLs."""
    rows = reduce(DataFrame.unionByName, [s.select(*by, "source", *ESTIMATE) for s in sources])
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    best = rows.groupBy(*by).agg(F.min_by(F.struct("source", *ESTIMATE), order).alias("_b"))
    return groups.select(*by).distinct().join(best, by, "left").select(*by, "_b.*").fillna(0.0, ["confidence"])


def experience_bucket(years: Column) -> Column:
    """Bucket name of years of experience, ALL when unknown."""
    named = reduce(lambda acc, b: F.when(years < b[0], b[1]).otherwise(acc), reversed(BUCKETS), F.lit("ABOVE_FIFTEEN"))
    return F.when(years.isNull(), "ALL").otherwise(named)


def bucket_band(bucket: Column) -> Column:
    none = F.lit(None).cast("struct<min:double,max:double>")
    return reduce(lambda acc, kv: F.when(bucket == kv[0], F.struct(F.lit(kv[1][0]).alias("min"), F.lit(kv[1][1]).alias("max"))).otherwise(acc), BUCKET_BANDS.items(), none)


def estimate_lookup(requests: DataFrame, estimates: DataFrame, now: Column) -> DataFrame:
    """The request's bucket estimate, else the ALL one, not older than a week."""
    asked = requests.select("candidate_id", "role", "city", F.explode(F.array(
        F.struct(F.lit(1).alias("step"), experience_bucket(F.col("experience_years")).alias("bucket")),
        F.struct(F.lit(2).alias("step"), F.lit("ALL").alias("bucket")))).alias("_b")).select("candidate_id", "role", "city", "_b.*")
    fresh = estimates.where(F.col("fetched_at").cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(days=F.lit(ESTIMATE_TTL_DAYS)))
    return keep_one(asked.join(fresh, ["role", "city", "bucket"]), ["candidate_id", "role", "city"], [F.asc("step"), F.desc("fetched_at")]).drop("step")


def source_band(source: Column, tier: Column, bucket: Column, role_band: Column) -> Column:
    """The experience band described by the salary source in use."""
    none = F.lit(None).cast("struct<min:double,max:double>")
    tiers = reduce(lambda acc, kv: F.when(tier == kv[0], F.struct(F.lit(kv[1][0]).alias("min"), F.lit(kv[1][1]).alias("max"))).otherwise(acc), TIER_BANDS.items(), none)
    return F.coalesce(F.when(source == "market_percentiles", tiers), F.when(source == "external_estimate", bucket_band(bucket)), role_band)


def candidate_value(df: DataFrame, *, match: Column, years: Column, band: Column) -> DataFrame:
    """Where a candidate likely sits in the market range (Y08). Needs the estimate columns."""
    adjust = F.greatest(F.lit(0.8), F.least(F.lit(1.2), 1.0 + 0.2 * (match - 0.70)))
    lo, hi = band["min"], band["max"]
    position = F.when(band.isNull(), 0.5).when(hi <= lo, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (years - lo) / F.nullif(hi - lo, F.lit(0.0)))))
    width = F.col("estimated_max") - F.col("estimated_min")
    centre = (F.col("estimated_min") + position * width) * adjust
    half = width * (0.15 + 0.35 * (1.0 - F.col("confidence")))
    known = F.col("estimated_median").isNotNull()
    return df.select("*", F.when(known, round_to_step(centre - half, 10_000)).alias("value_min"), F.when(known, round_to_step(centre + half, 10_000)).alias("value_max"),
                     F.when(known, F.round(F.col("confidence") * 0.9, 2)).otherwise(0.0).alias("value_confidence"),
                     F.when(known, F.round(adjust, 3)).otherwise(1.0).alias("adjustment"), F.when(known, F.round(position, 3)).alias("market_position"))


def negotiate(df: DataFrame) -> DataFrame:
    """Target and reasonable minimum from the posted and the candidate's range.

    Needs value_min, value_max, value_confidence, salary_min, salary_max and salary_is_predicted.
    """
    lo, hi = F.col("value_min"), F.col("value_max")
    mid = (lo + hi) / 2.0
    posted = (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()) & ~F.coalesce("salary_is_predicted", F.lit(False))
    p_lo, p_hi = F.coalesce("salary_min", "salary_max"), F.coalesce("salary_max", "salary_min")
    target = F.when(posted & (p_hi >= hi), hi).when(posted & (p_hi >= mid), p_hi).otherwise(mid)
    floor = F.when(posted & (p_hi >= mid), F.greatest(p_lo, lo)).when(posted, F.greatest(p_hi, lo)).otherwise(lo)
    known = lo.isNotNull()
    return df.select(
        "*", F.when(known, round_to_step(target, 50_000)).alias("recommended_target"),
        F.when(known, round_to_step(F.least(floor, target), 50_000)).alias("reasonable_minimum"),
        F.when(known, F.round(F.col("value_confidence") * F.when(posted, 1.0).otherwise(0.85), 2)).otherwise(0.0).alias("negotiation_confidence"),
        lakhs_range(lo, hi).alias("candidate_range"))
