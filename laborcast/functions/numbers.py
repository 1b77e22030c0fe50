"""Salary, experience and other numeric text turned into numbers with native expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values
INR_TO_USD = 0.012
SALARY_FLOOR = 50_000
SALARY_CEILING = 20_000_000
MAX_YEARS = 40.0
PERIODS_PER_YEAR = {"YEAR": 1, "MONTH": 12}


def group(text: Column, pattern: str, idx: int) -> Column:
    """A regular-expression group, NULL where the pattern or the group does not match."""
    found = F.regexp_extract(text, pattern, idx)
    return F.when(found != "", found)


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def pair(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("min"), hi.cast("double").alias("max"))


def parse_number(text: Column, default: float | None = 0.0) -> Column:
    """Tolerant float with a default for missing or malformed text."""
    value = to_double(F.trim(text))
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_int(text: Column, default: int | None = None) -> Column:
    value = to_double(F.trim(text))
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")
    return whole if default is None else F.coalesce(whole, F.lit(default))


def positive_number(text: Column) -> Column:
    """Number without commas and currency signs; NULL unless above zero."""
    value = to_double(F.trim(F.regexp_replace(text, "[,$₹]", "")))
    return F.when(value > 0, value)


def inr_salary(text: Column) -> Column:
    """Struct (min, max) in rupees from "3-6 Lacs PA" or "150000 - 225000" (B04)."""
    s = F.trim(F.regexp_replace(text, "[,₹]", ""))
    lakh = r"(?i)(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)\s*(lacs?|lakhs?|lpa)"
    plain = r"(\d{5,})\s*[-–to]+\s*(\d{5,})"
    in_lakh = s.rlike(lakh)
    lo = F.when(in_lakh, to_double(group(s, lakh, 1)) * 100000).otherwise(to_double(group(s, plain, 1)))
    hi = F.when(in_lakh, to_double(group(s, lakh, 2)) * 100000).otherwise(to_double(group(s, plain, 2)))
    return pair(lo, hi)


def years_range(text: Column) -> Column:
    """Struct (min, max) of years from "3-6 Yrs"; "3+" gives (3, NULL)."""
    ranged = r"(\d+\.?\d*)\s*[-–to]+\s*(\d+\.?\d*)"
    single = r"(\d+\.?\d*)\+?"
    is_range = text.rlike(ranged)
    lo = F.when(is_range, to_double(group(text, ranged, 1))).otherwise(to_double(group(text, single, 1)))
    return pair(lo, to_double(group(text, ranged, 2)))


def posting_years(text: Column) -> Column:
    """Struct (min, max) of years asked for in free text: a range, then a minimum, then a plain figure."""
    unit = r"(?:years?|yrs?)"
    num = r"(\d{1,2}(?:\.\d)?)"
    ranged = rf"(?i){num}\s*(?:-|–|to)\s*{num}\s*\+?\s*{unit}"
    least = (rf"(?i)(?:minimum\s+(?:of\s+)?)?{num}\s*\+\s*{unit}"
             rf"|(?:minimum|min\.?|at least)\s+(?:of\s+)?{num}\s*{unit}")
    plain = rf"(?i){num}\s*{unit}(?:\s+of)?\s+(?:relevant\s+|professional\s+|work\s+)?experience"
    lo, hi = to_double(group(text, ranged, 1)), to_double(group(text, ranged, 2))
    use_range = (lo <= hi) & (hi <= MAX_YEARS)
    floor = F.when(text.rlike(least), to_double(F.coalesce(group(text, least, 1), group(text, least, 2)))) \
        .otherwise(to_double(group(text, plain, 1)))
    return pair(F.when(use_range, lo).otherwise(F.when(floor <= MAX_YEARS, floor)), F.when(use_range, hi))


def inr_to_usd(inr: Column) -> Column:
    """Rupees to dollars at the fixed rate, two decimals."""
    return F.round(F.when(inr != 0, inr) * INR_TO_USD, 2)


def unit_interval(value: Column, digits: int = 4) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), digits)


def importance_norm(importance: Column) -> Column:
    """Rating 1-5 scaled to 0-1."""
    return unit_interval((importance - 1.0) / 4.0)


def level_norm(level: Column) -> Column:
    """Rating 0-7 scaled to 0-1."""
    return unit_interval(level / 7.0)


def plausible_salary(amount: Column) -> Column:
    """Whole yearly rupees inside the plausible band, else NULL."""
    whole = F.bround(amount.cast("double"), 0)
    return F.when(whole.between(SALARY_FLOOR, SALARY_CEILING), whole.cast("long"))


def yearly_amount(amount: Column, period: Column) -> Column:
    """Plausible yearly salary of a YEAR or MONTH amount; other periods are NULL."""
    unit = F.upper(F.coalesce(F.when(period != "", period), F.lit("YEAR")))
    factor = F.when(unit == "YEAR", PERIODS_PER_YEAR["YEAR"]).when(unit == "MONTH", PERIODS_PER_YEAR["MONTH"])
    return plausible_salary(amount.cast("double") * factor)


def ordered_pair(lo: Column, hi: Column) -> Column:
    """Struct (min, max) with the ends swapped when given the wrong way round."""
    both = lo.isNotNull() & hi.isNotNull()
    return F.struct(F.when(both, F.least(lo, hi)).otherwise(lo).alias("min"),
                    F.when(both, F.greatest(lo, hi)).otherwise(hi).alias("max"))


def round_to_step(amount: Column, step: int) -> Column:
    """Round half up to a multiple of ``step``."""
    return (F.floor(amount / step + 0.5) * step).cast("long")


def lakhs(amount: Column) -> Column:
    """1250000 -> "12.5", 1200000 -> "12" (B32)."""
    return F.regexp_replace(F.format_string("%.1f", amount.cast("double") / 100000), r"\.0$", "")


def lakhs_range(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lakhs(lo), F.lit("-"), lakhs(hi), F.lit(" LPA")))
