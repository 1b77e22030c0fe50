"""Date text columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import group


def year_month(text: Column) -> Column:
    """Struct (year, month) from epoch digits, ``Y-M...`` or ``D/M/Y``."""
    s = F.trim(text)
    digits = s.rlike(r"^\d{10,}$")
    epoch = F.when(digits, s.try_cast("double"))
    stamp = F.timestamp_seconds(F.when(epoch > 1e12, epoch / 1000).otherwise(epoch))
    iso, dmy = r"^(\d{4})-(\d{1,2})", r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    is_iso = s.rlike(iso)
    year = F.when(digits, F.year(stamp)).when(is_iso, group(s, iso, 1).cast("int")).otherwise(group(s, dmy, 3).cast("int"))
    month = F.when(digits, F.month(stamp)).when(is_iso, group(s, iso, 2).cast("int")).otherwise(group(s, dmy, 2).cast("int"))
    return F.struct(year.alias("year"), month.alias("month"))


def posted_timestamp(text: Column) -> Column:
    """Timestamp from epoch seconds or ISO-8601 text, NULL when neither."""
    s = F.trim(text)
    return F.coalesce(F.timestamp_seconds(F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))),
                      F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), s.try_cast("timestamp")))


def age_hours(since: Column, now: Column) -> Column:
    """Hours between two timestamps, never negative, one decimal."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1e6
    return F.round(F.greatest(F.lit(0.0), seconds / 3600), 1)


def age_text(hours: Column) -> Column:
    """"fetched 25 min ago" under an hour, else "fetched 10 h ago" (B33)."""
    figure = F.regexp_replace(F.format_string("%.1f", hours), r"\.0$", "")
    return F.when(hours < 1, F.concat(F.lit("fetched "), F.bround(hours * 60, 0).cast("int").cast("string"), F.lit(" min ago"))) \
        .when(hours.isNotNull(), F.concat(F.lit("fetched "), figure, F.lit(" h ago")))
