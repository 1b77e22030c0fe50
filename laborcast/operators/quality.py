"""Data-quality checks: each returns the violations, and nothing when the data is sound."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def coverage(df: DataFrame, column: str, *, min_distinct: int, min_rows: int) -> DataFrame:
    """A row when a table has too few rows or distinct values."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(column).alias("distinct_values"))
    return seen.where((F.col("rows") < min_rows) | (F.col("distinct_values") < min_distinct))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def forbidden_terms(df: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Rows whose value is a forbidden term."""
    return df.join(terms.select(F.lower("term").alias("_t")).distinct(), F.lower(F.col(column)) == F.col("_t"), "left_semi")


def violations(df: DataFrame, sound: Column) -> DataFrame:
    """Rows for which a condition does not hold; NULL counts as a violation."""
    return df.where(~F.coalesce(sound, F.lit(False)))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to nothing."""
    return df.join(parent.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def thin_entities(df: DataFrame, by: list[str], minimums: dict[str, Column | int]) -> DataFrame:
    """Entities with fewer rows of a kind than required (D07). ``minimums`` maps an item type to its least count."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col("item_type") == t).alias(t) for t in minimums])
    short = F.lit(False)
    for t, least in minimums.items():
        short = short | (F.col(t) < least)
    return counts.where(short)
